"""The engine's front: documents in, tokens, elements and matches out."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import matches as m
from .operators import stats, structure, tokens, validate
from .plans.xpath_plan import compile_xpath
from .sources.documents import from_column, load_files


_KEY = "_doc"


@dataclass
class Documents:
    """Documents of a DataFrame; every method is lazy but count, preview and timings.

    Each row is a document of its own.  Ids may repeat and be null: rows are then told apart by id, content and an ordinal among equal
    ones, at the cost of a shuffle.  `unique_ids` says that they are unique and not null, which saves it; wrong results follow where they are not.
    """

    df: DataFrame
    id_col: str = "doc_id"
    content_col: str = "content"
    skip_misc: bool = False
    stored: DataFrame | None = None
    unique_ids: bool = False

    def _rows(self) -> tuple[DataFrame, str]:
        """The documents with a key, and its name."""
        if self.unique_ids:
            return self.df, self.id_col
        same = F.struct(F.col(self.id_col).alias("id"), F.xxhash64(self.content_col).alias("hash"))
        number = F.row_number().over(Window.partitionBy(_KEY).orderBy(_KEY))
        return self.df.withColumn(_KEY, same).withColumn(_KEY, F.struct(f"{_KEY}.id", f"{_KEY}.hash", number.alias("number"))), _KEY

    def _shown(self, out: DataFrame) -> DataFrame:
        """Ids instead of keys."""
        if _KEY not in out.columns:
            return out
        return out.select(F.col(f"{_KEY}.id").alias(self.id_col), *[c for c in out.columns if c not in (_KEY, self.id_col)])

    def _elements(self) -> tuple[DataFrame, str]:
        if self.stored is not None:
            return self.stored, _KEY if _KEY in self.stored.columns else self.id_col
        rows, key = self._rows()
        return structure.elements(rows, key, self.content_col, self.skip_misc), key

    def valid(self, strict: bool = False) -> Documents:
        """Without malformed documents; strict raises MalformedXmlError instead."""
        rows, key = self._rows()
        return replace(self, df=validate.well_formed(rows, key, self.content_col, strict, self.skip_misc).select(*self.df.columns))

    def errors(self) -> DataFrame:
        rows, key = self._rows()
        return self._shown(validate.errors(rows, key, self.content_col, self.skip_misc))

    def verdicts(self) -> DataFrame:
        rows, key = self._rows()
        return self._shown(validate.verdicts(rows, key, self.content_col, self.skip_misc))

    def tokens(self) -> DataFrame:
        rows, key = self._rows()
        return self._shown(tokens.tokens(rows, key, self.content_col))

    def elements(self) -> DataFrame:
        return self._shown(self._elements()[0])

    def store(self, path: str) -> Documents:
        """Writes the element table once, for many queries; these then read the columns and rows that they need."""
        self._elements()[0].write.mode("overwrite").parquet(path)
        return replace(self, stored=self.df.sparkSession.read.parquet(path))

    def _select(self, path: str, strategy: str = "auto", affix_compat: bool = False) -> tuple[DataFrame, str]:
        if strategy == "auto" and self.stored is None:
            strategy = "window"
        elements, key = self._elements()
        return compile_xpath(elements, path, key, strategy, affix_compat), key

    def select(self, path: str, strategy: str = "auto", affix_compat: bool = False) -> DataFrame:
        """Elements that the path selects.  Unless they are stored, elements are computed once and the window plan carries them;
        the join plan would compute them for each step."""
        return self._shown(self._select(path, strategy, affix_compat)[0])

    def _matches(self, path: str, strategy: str = "auto", raw: bool = False, entities: bool = False, affix_compat: bool = False) -> tuple[DataFrame, str]:
        selected, key = self._select(path, strategy, affix_compat)
        rows = (self.df if key == self.id_col else self._rows()[0]) if raw else None
        return m.matches(selected, key, rows, self.content_col, entities), key

    def xpath(self, path: str, strategy: str = "auto", raw: bool = False, entities: bool = False, affix_compat: bool = False) -> DataFrame:
        """Matches (id, match_no, start_off, end_off, raw, text); raw=True also cuts out elements with children."""
        return self._shown(self._matches(path, strategy, raw, entities, affix_compat)[0])

    def count(self, path: str) -> int:
        return self._select(path)[0].count()

    def counts(self, path: str) -> DataFrame:
        return self._shown(m.match_counts(*self._select(path)))

    def preview(self, path: str, n: int = 10) -> list[str]:
        return [r["raw"] for r in m.preview(*self._matches(path, raw=True), n).collect()]

    def stats(self) -> DataFrame:
        rows, key = self._rows()
        return self._shown(stats.doc_stats(rows, key, self.content_col))

    def timings(self, path: str) -> dict[str, float]:
        """Seconds of each stage, each run on its own to the end."""
        stages = {
            "validation": lambda: validate.utf8_flags(self.df, self.id_col, self.content_col),
            "tokenization": lambda: tokens.token_counts(self.df, self.id_col, self.content_col),
            "structure": lambda: self._elements()[0],
            "query": lambda: self._select(path)[0],
        }
        out = {}
        for name, stage in stages.items():
            began = time.perf_counter()
            stage().write.format("noop").mode("overwrite").save()
            out[name] = time.perf_counter() - began
        return out


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def load(self, path: str, glob: str | None = None, **options) -> Documents:
        return Documents(load_files(self.spark, path, glob), unique_ids=True, **options)

    def table(self, df: DataFrame, id_col: str, content_col: str, **options) -> Documents:
        return Documents(from_column(df, id_col, content_col), **options)
