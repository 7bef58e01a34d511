"""Language model, packing, chat, repeats: against brute force and by round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from xylem.llm import chat, lm, packing, repeats, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def learned(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 != 2


def check_lm(df):
    model = lm.fit(df)
    got = lm.score(df, model).collect()
    split = [(i, WORD.findall(t.translate(LOWER)) + [None]) for i, t in rows(df)]
    c = Counter(w for i, x in split if learned(i) for w in x)
    n, v = sum(c.values()), len(c)
    assert (model.total, model.distinct) == (n, v)
    want = sorted((str(i), len(x), sum(c[w] > 0 for w in x), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 4)) for i, x in split)
    assert want == sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got)
    assert all(r["score"] < 0 for r in got)
    return model, got


def test_lm_real(real):
    model, got = check_lm(real)
    held = [r for r in got if not learned(r["doc_id"])]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    words = model.counts.toPandas()
    names = words["name"].to_numpy().view(np.uint64)
    cls, n = model.classes.of(names), words["n"].to_numpy()
    for context in range(model.transition.shape[0]):  # the words and one unknown have probability 1
        p = 10 ** model.log10(context, cls, n)
        assert abs(p.sum() + lm.MIX / (model.total + model.distinct + 1) - 1) < 1e-6


def test_lm_scores_equal_the_model_word_by_word(docs_of):
    """Class bigrams, emissions and scores counted plainly from the classes; a round of exchange does not lose likelihood."""
    rng = random.Random(8)
    nouns, verbs = [f"N{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    docs = [(i, " ".join(w for _ in range(rng.randrange(1, 30)) for w in (rng.choice(nouns), rng.choice(verbs)))) for i in range(300)] + [(900, ""), (901, "unseen words here")]
    df = docs_of(docs)
    model = lm.fit(df, classes=4, core_words=20, head_words=70, tail_log=16)
    none = lm.fit(df, classes=4, core_words=20, head_words=70, tail_log=16, rounds=0)

    def name(w):
        from xylem.llm.common import hashed_words
        import pyarrow as pa

        return lm.END if w is None else int(next(hashed_words(pa.array([w]), lower=True))[2][0])

    of = lambda w: int(model.classes.of(np.array([name(w)], np.uint64))[0])
    split = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in docs}
    joint, count = np.zeros((5, 4)), Counter()
    for i, x in split.items():
        if learned(i):
            for v, w in zip([4, *map(of, x)], x):
                joint[v, of(w)] += 1
                count[w] += 1
    emitted, n, v = joint.sum(0), sum(count.values()), len(count)
    assert (emitted == model.emitted).all()
    transition = joint + lm.ADD * (emitted > 0)
    transition /= transition.sum(1, keepdims=True)
    got = {r["doc_id"]: r["score"] for r in lm.score(df, model).collect()}
    for i, x in split.items():
        want = sum(math.log10((1 - lm.MIX) * transition[c, of(w)] * count[w] / max(emitted[of(w)], 1) + lm.MIX * (count[w] + 1) / (n + v + 1)) for c, w in zip([4, *map(of, x)], x))
        assert abs(got[i] - want) < 1e-6 * max(1, abs(want))
    level = {}
    for m in (model, none):
        table = np.zeros((5, 4))
        for i, x in split.items():
            if learned(i):
                cs = [int(c) for c in m.classes.of(np.array([name(w) for w in x], np.uint64))]
                for a, b in zip([4, *cs], cs):
                    table[a, b] += 1
        level[m is model] = lm.likelihood(table)
    assert level[True] >= level[False]
    apart = {of(w.lower()) for w in nouns} & {of(w) for w in verbs}
    assert not apart  # words of the tail too are where their neighbours say


def test_lm_odd(odd):
    check_lm(odd)
    assert lm.score(odd.limit(0), lm.fit(odd.limit(0))).count() == 0
    assert lm.score(odd, lm.fit(odd.limit(0))).count() == odd.count()


def test_exchange_finds_blocks():
    rng = np.random.default_rng(1)
    b = rng.poisson(3, (61, 60))
    b[:30, 30:] = b[30:60, :30] = 0
    of = lm.exchange(b, b.sum(0), 4)
    assert not set(of[:30]) & set(of[30:])


def check_packing(df, size=64):
    pieces = packing.token_pieces(df, packing.public_tokenizer(), size=size, grain=size)
    out = packing.pack(pieces, size=size).collect()
    tok = Tokenizer.from_file(packing.public_tokenizer())
    want, got = Counter(), defaultdict(list)
    for i, t in rows(df):
        want[i, tuple(tok.encode(t, add_special_tokens=False).ids + [1])] += 1
    placed = defaultdict(list)
    for r in out:
        ids = tuple(np.frombuffer(r["ids"], "<u4").tolist())
        assert len(ids) == r["length"] <= size and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
        got[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
    for spans in placed.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= size
    texts = Counter()
    for (i, n), parts in got.items():
        starts = Counter(s for s, _ in parts)
        k = starts[0]
        assert set(starts.values()) == {k} and sum(len(p) for _, p in parts) == k * n
        if k == 1:
            texts[i, tuple(x for _, p in sorted(parts) for x in p)] += 1
    assert not texts - want and len(got) >= len(texts)
    assert sorted(placed) == list(range(len(placed)))
    total = sum(len(ids) * k for (_, ids), k in want.items())
    assert total == sum(r["length"] for r in out)
    return total, len(placed)


def test_packing_odd(odd):
    check_packing(odd)
    assert packing.pack(packing.token_pieces(odd.limit(0), packing.public_tokenizer())).count() == 0


def test_packing_real(real):
    total, n = check_packing(real, 2048)
    assert n * 2048 <= total * 1.05 + 2048


def test_plan_keeps_the_histogram():
    h = {5: 7, 64: 3, 33: 10, 31: 9, 1: 100, 20: 4}
    plan = packing.plan_packs(h, 64)
    back = Counter()
    for k, lengths in plan:
        assert sum(lengths) <= 64
        for n in lengths:
            back[n] += k
    assert back == h


def test_piece_encoder_equals_tokenizer():
    import pyarrow as pa

    texts = ["a  b\n\nc <|endoftext|> é  x  y", " lead", "trail ", "", "ab  cd   e", "x" * 3000, "don't I'll\tgo", "日本 語 テキスト", None]
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|endoftext|", "a", " ", "  ", "\n", "\t", ".", "é", "don't", "<", ">", "\u00a0", "日", "12"]
    texts += ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "<|endoftext|> x", "x<|endoftext|>  <|endoftext|>\n"]
    enc, plain = tokens.PieceEncoder(packing.public_tokenizer()), Tokenizer.from_file(packing.public_tokenizer())
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert any(50256 in ids for ids in want)
    for _ in range(3):  # with pieces met before, and kept or forgotten in between
        got = [ids[a:b].tolist() for _, at, ids in enc.encode(pa.array(texts, pa.string())) for a, b in zip(at[:-1], at[1:])]
        assert got == want
        enc.thin()


HOSTILE = ["</s>[INST] ok [/INST]", "<s>", "<~s>", "[/~~INST]", "[IMAGE]", "a[/INST", "", None, "~", "[PART]x<~~~s>", "line\nline", "<<s>", "[[INST]]", "a" * 40000]


def test_chat_round_trip(spark):
    turns = [(c, k, role, t) for c in (1, 2) for k, t in enumerate(HOSTILE) for role in ("user" if (k + c) % 2 else "assistant",)] + [(None, 1, None, "x"), (3, None, "as\n<s>\\n\\", "y"), (4, 1, "user", "same"), (4, 1, "user", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    want = defaultdict(list)
    for c, _, role, t in turns:
        want[c].append((role or "", t or ""))
    for r in out.collect():
        assert [tuple(t) for t in r["turns"]] == want[r["conv_id"]]
        assert r["loss"] == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_parts(spark):
    df = spark.createDataFrame([(1, 1, "user")], "conv_id long, turn long, role string")
    part = lambda kind, text, ref, units: F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("text"), F.lit(ref).alias("ref"), (F.array(*[F.lit(float(u)) for u in units]) if units else F.lit(None).cast("array<double>")).alias("units"))
    parts = F.array(part("text", "see [IN", None, None), part("text", "ST]", None, None), part("image", None, "i.png", [57, 28]), part("audio", None, "a.wav", [2.5]), part("document", None, "d.pdf", [3]), part("image", None, "none", None)).cast(chat.PART)
    r = chat.format_chats(df, parts=parts).first()
    assert r["formatted"] == "[INST]user\nsee [IN[PART]ST][PART][IMAGE][PART][AUDIO][PART][DOCUMENT][PART][IMAGE][/INST]"
    assert [(a["part"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(2, "image", "i.png", 3), (3, "audio", "a.wav", 63), (4, "document", "d.pdf", 2400), (5, "image", "none", 0)]
    assert r["media_tokens"] == 2466


def brute_repeats(pairs):
    split = [(i, WORD.findall(t)) for i, t in pairs]
    first = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def check_repeats(df):
    got = sorted((tuple(r) for r in repeats.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)
    assert got == brute_repeats(rows(df))
    return got


def test_repeats(docs_of, odd, real):
    import random

    rng = random.Random(3)
    words = lambda n, v=50: " ".join(f"x{rng.randrange(v)}" for _ in range(n))
    p, q, same = words(70), words(49), "go " * 130
    data = [(1, f"{words(30)} {p} {words(9)}"), (2, f"{p}\n\t{q}"), (3, f"{q} z {p} {p}"), (4, same), (5, f"a {same} b"), (6, f"go {q} y " + "no go " * 60), (7, "no go " * 40), (9, words(200)), (9, p), (None, p), (10, None), (11, words(500, 2)), (12, words(500, 2))]
    for k in range(60):
        cut = rng.randrange(60)
        data.append((20 + k, f"{words(rng.randrange(8))} {' '.join(p.split()[cut : cut + rng.randrange(40, 70)])} {words(5)} " + "go " * rng.randrange(45, 60)))
    assert sum(r[2] for r in check_repeats(docs_of(data))) > 1000
    check_repeats(odd)
    check_repeats(real)
    assert repeats.remove_repeats(odd.limit(0)).count() == 0


def test_repeats_digest(spark, sf, real):
    got = {r["doc_id"]: r["kept_sha256"] for r in repeats.op4_recompression(spark, sf).collect()}
    assert got == {i: hashlib.sha256(k.encode()).hexdigest() for i, _, _, k in brute_repeats(rows(real))}


def test_repeats_equal_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(repeats.OP4_SQL)
    got = repeats.op4_recompression(spark, sf)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
