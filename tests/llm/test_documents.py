"""Fingerprints, near-duplicates, personal data, mixing, media, language, pipeline."""

import hashlib
import io
import random
import re
import time
import wave
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from xylem.llm import fingerprints, langid, media, mixing, near, privacy

SF001 = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def clash(df):
    """Extra columns whose names the operators might use themselves."""
    return df.withColumns({c: F.lit("x") for c in ("_key", "_text", "_base", "_node", "key", "id", "name", "n", "node", "spans", "base_spans", "class", "k0", "c0", "start", "count", "bucket")})


def shingles(t):
    w = WORD.findall(t or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_fingerprints(real):
    both, follow = fingerprints.edited_pairs(real)
    nexts = {r["_key"]: (r["_id"], r["_next"]) for r in follow.collect()}
    docs = {r["doc_id"]: r["text"] for r in real.collect()}
    ids = sorted(docs, reverse=True)
    after = {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}
    got = both.select("_key", "edited_sha256", "n_chars", fingerprints.likeness(F.col("_own"), F.col("_other")).alias("near"), fingerprints.pack(F.col("_own")).alias("stored")).collect()
    errors = []
    assert len(got) == len(docs)
    for r in got:
        i, following = nexts[r["_key"]]
        assert nexts[following][0] == after[i] and len(r["stored"]) == 128
        t, n = docs[i], len(docs[i])
        edited = t[: n - n // 3] + docs[after[i]][: n // 3]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        errors.append(r["near"] - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_fingerprints_odd(odd, docs_of):
    both, follow = fingerprints.edited_pairs(clash(odd))
    assert both.count() == odd.count()
    assert follow.count() == odd.select("doc_id", "text").distinct().count()
    assert fingerprints.edited_pairs(odd.limit(0))[0].count() == 0
    one, _ = fingerprints.edited_pairs(docs_of([(1, "abcdef")]))
    assert one.first()["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    same = fingerprints.fingerprint(odd, "text", "f").groupBy(F.coalesce("text", F.lit(""))).agg(F.countDistinct("f").alias("k"))
    assert same.where("k > 1").count() == 0


def brute_classes(texts):
    s = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverse = defaultdict(set)
    for i, x in s.items():
        for g in x:
            inverse[g].add(i)
    pairs = {(a, b) for x in inverse.values() for a in x for b in x if a < b}
    for a, b in pairs:
        if 2 * len(s[a] & s[b]) / (len(s[a]) + len(s[b])) >= 0.8:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: find(i) for i in s}


def brute_links(texts):
    """Classes by alignment of all pairs."""
    from xylem.llm.common import hashed_words
    import pyarrow as pa

    ids = sorted(texts)
    runs = []
    for _, at, h, *_ in hashed_words(pa.array([texts[i] for i in ids])):
        runs += [near.runs_of(h[at[k] : at[k + 1]]) for k in range(len(at) - 1)]
    of = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if of[a] != of[b] and near.alignment_likeness(runs[a], runs[b]) >= near.LIKENESS:
                old, new = max(of[a], of[b]), min(of[a], of[b])
                of = [new if x == old else x for x in of]
    return {i: ids[c] for i, c in zip(ids, of, strict=True)}


def test_near_real(real):
    texts = {r["doc_id"]: r["text"] for r in real.collect()}
    got = {r["doc_id"]: r["class_id"] for r in near.classes(real).collect()}
    assert got == brute_classes(texts)


def test_near_chains_and_hot_groups(docs_of):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows, words = [], list(base)
    for i in range(40):  # each but its neighbours far from the others
        words = words[4:] + [f"n{i}-{k}" for k in range(4)]
        rows.append((100 + i, " ".join(words)))
    hot = [f"h{rng.randrange(10**6)}" for _ in range(120)]
    for i in range(300):
        x = list(hot)
        x[rng.randrange(120)] = f"e{i}"
        rows.append((1000 + i, " ".join(x)))
    rows += [(5000 + i, f"alone {i} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))) for i in range(30)]
    got = {r["doc_id"]: r["class_id"] for r in near.classes(docs_of(rows)).collect()}
    assert {got[100 + i] for i in range(40)} == {100} and {got[1000 + i] for i in range(300)} == {1000}
    assert all(got[5000 + i] == 5000 + i for i in range(30))


def test_near_odd(odd):
    kept = near.keep_one(clash(odd))
    assert kept.columns == clash(odd).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "7", "8", "9", "None"]
    assert near.keep_one(odd.limit(0)).count() == 0
    by = {r["doc_id"]: r["class_size"] for r in near.classes(odd).collect()}
    assert by[1] == 3 and by[2] == 4  # without words: null, empty, white space, and null with null id


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {(x, find(x)) for a, b in pairs if a != b for x in (a, b)}
    for parts in (1, 7):  # links read by one task, and by several that must agree
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27 if parts > 1 else 1 << 22))
        links = spark.createDataFrame(pairs, "a long, b long").repartition(parts)
        assert {(r["node"], r["root"]) for r in near.components(links).collect()} == want
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 22))
    with pytest.raises(RuntimeError):
        near.components(links, most=0)


def test_far_copies_are_compared_by_bounds(docs_of, spark):
    """Copies of one text, many too far from it: classes equal brute force, and few pairs are compared."""
    rng = random.Random(12)
    words = [f"v{k}" for k in range(400)]
    base = rng.choices(words, k=140)
    rows = [(0, " ".join(base))]
    for i in range(1, 260):
        x = list(base)
        for _ in range(rng.randrange(1, 16)):
            x[rng.randrange(140)] = rng.choice(words[:6])
        cut = rng.randrange(3) and 140 - rng.randrange(40)
        rows.append((i, " ".join(x[: cut or 140])))
    texts = dict(rows)
    compared, plain = [], near.verify
    near.verify = lambda pairs, *a: compared.append(pairs) or plain(pairs, *a)
    try:
        got = {r["doc_id"]: r["class_id"] for r in near.classes(docs_of(rows)).collect()}
    finally:
        near.verify = plain
    want = brute_links(texts)
    assert got == want and len(set(want.values())) > 20
    assert len(compared) == 3 and compared[2].count() < 260 * 259 / 2 / 8


def test_alignment():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 100).astype(np.uint64)
    assert near.alignment_likeness(a, a) == 1
    b = np.concatenate([a[:50], rng.integers(0, 2**63, 10).astype(np.uint64), a[50:]])
    assert near.alignment_likeness(a, b) == pytest.approx(200 / 210)
    assert near.alignment_likeness(a, np.concatenate([a[50:], a[:50]])) == 0
    swapped = a.copy()
    swapped[[3, 4]] = swapped[[4, 3]]
    assert near.alignment_likeness(a, swapped) == pytest.approx(0.99)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda x: [int(c) for c in x if c in "0123456789"]

    def luhn(d):
        return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(2)
    parts = ["4111-1111-1111-1111", "4111 1111 1111 1111", "+49 (30) 123-4567", "10.0.0.255", "1.2.3.400", "a.b@c-d.org", "x@y", " ", ".", "-", "é", "7"]
    seen = set()
    for _ in range(6000):
        t = "".join(rng.choice("a@.b-+ 5é(") for _ in range(rng.randrange(40))) if rng.random() < 0.5 else "".join(rng.choices(parts, k=rng.randrange(6)))
        assert privacy.base_spans(t) == plain_spans(t), t
        seen |= {k for k, _, _ in plain_spans(t)}
    assert len(seen) == 4
    assert privacy.base_spans("0" * 5000 + "1.2.3.4")[0] == ("ip", 0, 5007) and privacy.base_spans("1.2.3." + "0" * 6000)[0] == ("ip", 0, 6006)
    began = time.perf_counter()
    privacy.base_spans("7" * 400_000 + " " + "1." * 100_000 + "a" * 200_000 + "@" * 1000)
    assert time.perf_counter() - began < 10
    assert privacy.luhn("4111111111111111") and not privacy.luhn("4111111111111112")


def test_disclosing_terms(docs_of):
    rng = random.Random(1)
    common = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(common, k=30))) for i in range(600)]
    for i in range(5):
        rows[i] = (i, rows[i][1] + f" Rosebud, wrote to ann@x.org u{i}")
    out = {r["doc_id"]: r for r in privacy.personal_spans(docs_of(rows)).collect()}
    for i, t in rows:
        got = [(s["kind"], t[s["start"] : s["end"]]) for s in out[i]["spans"]]
        named = [("email", "ann@x.org"), ("remove", "Rosebud"), ("remove", "wrote"), ("remove", "to")]
        assert got == (named if i < 5 else [])
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(privacy.personal_spans(docs_of(rows))).collect()}
    assert clean[0].endswith("[EMAIL] u0") and "Rosebud" not in clean[0] and clean[9] == rows[9][1]


def test_disclosing_terms_of_hot_entities(docs_of):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices([f"c{k}" for k in range(40)], k=30)) + f" r{rng.randrange(150)}") for i in range(600)]
    for i in range(300):  # a third of the rows hold one address, fifty another
        if i < 200:
            rows[i] = (i, rows[i][1] + " Rosebud ann@x.org")
        elif i < 250:
            rows[i] = (i, rows[i][1] + " Xanadu +49 30 1234567")
    rows[300:304] = [(300 + i, "twin Alpha Beta Gamma c1 c2 c3 c4 c5 c6 bob@x.org") for i in range(4)]  # copies are no evidence of what stands apart
    for n in (600, 250):  # alike in a small table
        out = {r["doc_id"]: r for r in privacy.personal_spans(docs_of(rows[:n])).collect()}
        for i, t in rows[:n]:
            got = {t[s["start"] : s["end"]] for s in out[i]["spans"] if s["kind"] in ("remove", "generalise")}
            assert got == ({"Rosebud"} if i < 200 else {"Xanadu"} if i < 250 else set()), i
    everywhere = [(i, f"word{i} Rosebud ann@x.org") for i in range(9)]  # held by all: nothing is told
    assert all(len(r["spans"]) == 1 for r in privacy.personal_spans(docs_of(everywhere)).collect())


def plain_disclosure(texts, remove, generalise, alpha, width):
    """The spans that the method adds, from its definition: {id: {(term, kind)}}."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    total = len(texts)
    n_t, n_e, texts_e = defaultdict(int), defaultdict(int), defaultdict(set)
    pairs = {k: (defaultdict(int), defaultdict(set)) for k in ("near", "far")}
    entities, free_of = {}, {}
    for i, text in texts.items():
        spans = privacy.base_spans(text)
        spans += privacy.secret_spans(text, spans)
        words = [(m.start(), m[0].strip(privacy._TRIM).translate(low)) for m in WORD.finditer(text)]
        words = [(a, w) for a, w in words if len(w) > 1]
        for w in {w for _, w in words if w}:
            n_t[w] += 1
        free = [(a, w) for a, w in words if not any(x < a + len(WORD.match(text, a)[0]) and a < y for _, x, y in spans)]
        free_of[i] = {w for _, w in free}
        entities[i] = {privacy.entity_name(k, text[x:y]) for k, x, y in spans}
        for e in entities[i]:
            n_e[e] += 1
            texts_e[e].add(text)
        met = {"near": set(), "far": {(e, w) for e in entities[i] for _, w in free}}
        for k, x, y in spans:
            at = sum(a < x for a, _ in free)
            met["near"] |= {(privacy.entity_name(k, text[x:y]), w) for _, w in free[max(0, at - width) : at + width]}
        for kind, found in met.items():
            for p in found:
                pairs[kind][0][p] += 1
                pairs[kind][1][p].add(text)

    def chance(x, n, q):
        n = max(n, x, 1)
        r = x / n
        if x <= 0 or r <= q:
            return 0.0
        return -n * (r * np.log(r / q) + ((1 - r) * np.log((1 - r) / (1 - q)) if r < 1 else 0)) if q > 0 else -np.inf

    share = {}
    for kind, (rows, of) in pairs.items():
        terms = defaultdict(set)
        for e, w in rows:
            terms[e].add(w)
        for (e, w), n in rows.items():
            x, t = len(of[e, w]), max(n_t[w], n)
            if n_e[e] == total or (kind == "far" and (x < 2 or len(texts_e[e]) < 2)):
                continue
            p = chance(x, x * t / n, n_e[e] / total) if kind == "near" else chance(x - 1, t - n + x - 1, (n_e[e] - 1) / (total - 1))
            s = np.log(total * n / (n_e[e] * t)) / np.log(total / n_e[e])
            if p <= np.log(alpha / len(terms[e])) + 1e-9 and s >= generalise:
                share[e, w] = max(share.get((e, w), 0), s)
    by_entity = defaultdict(dict)
    for (e, w), s in share.items():
        by_entity[e][w] = s
    out = {}
    for i, own in entities.items():
        level = defaultdict(float)
        for e in own:
            for w, s in by_entity[e].items():
                level[w] = max(level[w], s)
        out[i] = {(w, "remove" if s >= remove else "generalise") for w, s in level.items() if w in free_of[i]}
    return out


def test_disclosure_equals_its_definition(spark):
    docs = spark.read.parquet(SF001.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = plain_disclosure(texts, privacy.REMOVE, privacy.GENERALISE, privacy.ALPHA, privacy.BESIDE)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kinds = defaultdict(int)
    for r in privacy.personal_spans(docs).collect():
        text = texts[r["doc_id"]]
        got = {(text[s["start"] : s["end"]].translate(low), s["kind"]) for s in r["spans"] if s["kind"] in ("remove", "generalise")}
        assert got == want[r["doc_id"]], r["doc_id"]
        for s in r["spans"]:
            kinds[s["kind"]] += 1
    assert kinds["generalise"] and kinds["remove"] and kinds["secret"]


def test_single_entities_and_secrets(docs_of):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"c{k}" for k in range(40)], k=30))) for i in range(3000)]
    for i in range(12):
        rows[i] = (i, rows[i][1] + f" Surname{i}, mail name{i}@x.org or key = \"{hashlib.sha1(bytes([i])).hexdigest()}\" now")
    out = {r["doc_id"]: r for r in privacy.personal_spans(docs_of(rows)).collect()}
    for i, t in rows:
        got = [(s["kind"], t[s["start"] : s["end"]]) for s in out[i]["spans"]]
        assert got == ([("email", f"name{i}@x.org"), ("secret", hashlib.sha1(bytes([i])).hexdigest()), ("remove", f"Surname{i}")] if i < 12 else []), i
    clean = privacy.sanitise(privacy.personal_spans(docs_of(rows))).where("doc_id = 3").first()["text"]
    assert clean.endswith(", mail [EMAIL] or key = \"[SECRET]\" now") and "Surname" not in clean
    for plain in ("path/to/some-long-page-of-2020/index", "x" * 40, "1234567890" * 4, "ABCDEFGHIJKLMNOPQRSTUVWXYZ1234"):
        assert not privacy.secret_spans(plain, [])


def test_private_odd(odd, real):
    out = privacy.sanitise(privacy.personal_spans(clash(odd)))
    assert out.columns == clash(odd).columns and out.count() == odd.count()
    assert privacy.personal_spans(odd.limit(0)).count() == 0
    for r in privacy.personal_spans(real).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["base_spans"]] == privacy.base_spans(r["text"] or "")
        assert r["spans"][: len(r["base_spans"])] == r["base_spans"]


def test_mixing(spark, sf, real):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model, rows = mixing.fit_mix(real, labels)
    got = mixing.rate_rows(rows, model).toPandas()
    p, n, r = np.stack(got["p"]), got["n"].to_numpy(), got["rate"].to_numpy()
    assert np.allclose(p.sum(1), 1) and (r >= 0).all() and (r <= 4).all()
    have = (n[:, None] * p).sum(0)
    target = mixing.weigh(mixing.WEIGHTS)(have)
    loss = lambda x: (((n * x) @ p - target) ** 2 / have).sum()
    best = np.ones(len(n))  # plain projected gradient with many steps
    top = np.linalg.eigvalsh((p * n[:, None]).T @ p / np.sqrt(np.outer(have, have))).max()
    for _ in range(2000):
        best = np.clip(best - p @ (((n * best) @ p - target) / have / top), 0, 4)
    assert loss(r) <= 1.001 * loss(best) + 1e-6 * loss(np.ones(len(n)))
    assert (np.abs((n * r) @ p - target) <= 0.01 * target).all() and (np.abs(model.missed) <= 0.01).all()
    short, _ = mixing.fit_mix(real, labels, total="first", high=1.0)  # targets out of reach: the least squares, and a word on what is missed
    target, r = mixing.weigh(mixing.WEIGHTS, "first")(have), short.rates(p)
    best = np.ones(len(n))
    for _ in range(4000):
        best = np.clip(best - p @ (((n * best) @ p - target) / have / top), 0, 1)
    assert loss(r) <= 1.001 * loss(best) + 1e-6 * loss(np.ones(len(n)))
    assert np.allclose(short.missed, ((n * r) @ p - target) / target) and short.missed[0] < -0.01
    truth = labels.select("doc_id", mixing.label_domain().alias("d")).toPandas().dropna().set_index("doc_id")["d"]
    guess = dict(zip(got["id"], p.argmax(1)))
    assert np.mean([guess[i] == d for i, d in truth.items() if i in guess]) > 0.9


def test_mixing_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 0), (None, 1, 0), (4, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    model, _ = mixing.fit_mix(clash(odd), labels)
    out = mixing.apply_mix(clash(odd), model)
    assert out.columns == clash(odd).columns
    assert mixing.fit_mix(odd, labels.limit(0))[1].count() == odd.count()
    model, rows = mixing.fit_mix(odd.limit(0), labels)
    assert rows.count() == 0 and mixing.apply_mix(odd.limit(0), model).count() == 0


def test_media(odd, real):
    for df in (odd, real):
        texts = defaultdict(list)
        for r in df.collect():
            texts[r["doc_id"]].append(r["text"] or "")
        for r in media.wav_columns(df).collect():
            with wave.open(io.BytesIO(r["media"])) as w:
                payload = w.readframes(w.getnframes())
            raw = payload[: r["n_bytes"]]
            assert raw.decode() in texts[r["doc_id"]] and set(payload[r["n_bytes"] :]) <= {255}
            assert len(payload) % 576 == 0 and len(payload) >= 576 and hashlib.sha256(payload).hexdigest() == r["payload_sha256"]
            assert len(r["times"]) == len(r["codes"]) and list(r["times"]) == sorted(r["times"])
    assert media.wav_columns(odd.limit(0)).count() == 0
    tone = (128 + 100 * np.sin(2 * np.pi * 60 * np.arange(576 * 4) / 576)).astype(np.uint8).tobytes()
    n, t, c = media.peak_pairs(tone)
    assert n == 7 and {(int(x) >> 4) & 511 for x in c if int(x) >> 22 == 1} == {60}


def test_langid(real, odd):
    model = langid.fit(real)
    got = {r["doc_id"]: r for r in langid.identify(real, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in real.where(langid.held_out()).collect()}
    assert np.mean([got[i]["lang_pred"] == x for i, x in truth.items()]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    out = langid.identify(clash(odd), model, keep=clash(odd).columns)
    assert {r["text"]: r["lang_pred"] == "und" for r in out.collect()} == {r["text"]: not re.search(r"[^\W\d_]", r["text"] or "") for r in odd.collect()}
    assert langid.identify(odd, None).where("lang_pred <> 'und'").count() == 0
    assert langid.fit(odd.limit(0)) is None and langid.identify(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("order", [2, 3, 5])
def test_code_lengths_by_hand(order):
    """The tables' code lengths equal those of a tree walked byte by byte, whatever bytes there are."""
    import pyarrow as pa

    from xylem.llm.common import text_bytes

    rng = random.Random(order)
    train = {"x": ["abracadabra", "abba", "日本語 кириллица"], "y": ["".join(chr(rng.randrange(32, 900)) for _ in range(300)), "abab"]}
    tests = ["abrac", "本語ки", "", "".join(chr(rng.randrange(1, 2000)) for _ in range(200)), "abababab"]
    model = langid.train_ppm(train, order)
    data, off = text_bytes(pa.array(tests))
    got = model.code_lengths(data, off)
    pad = [0] * order
    for x, texts in train.items():
        counts = defaultdict(lambda: defaultdict(int))
        for t in texts:
            s = [*pad, *t.encode()]
            for i in range(order, len(s)):
                for k in range(order + 1):
                    counts[tuple(s[i - k : i])][s[i]] += 1

        def cost(ctx, b):
            c = counts.get(ctx)
            if c and b in c:
                return -np.log2(c[b] / (sum(c.values()) + len(c)))
            esc = -np.log2(len(c) / (sum(c.values()) + len(c))) if c else 0
            return esc + (cost(ctx[1:], b) if ctx else 8)

        for r, t in enumerate(tests):
            s = [*pad, *t.encode()]
            want = sum(cost(tuple(s[i - order : i]), s[i]) for i in range(order, len(s)))
            assert got[r, model.langs.index(x)] == pytest.approx(want, rel=1e-4)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
    pieces = corpus_pipeline.run(spark, sf)
    assert set(pieces.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} and pieces.count() > 50


def test_pieces_are_encoded_as_the_library_does():
    import pyarrow as pa

    from xylem.llm import tokens
    from xylem.llm.packing import public_tokenizer

    enc = tokens.PieceEncoder(public_tokenizer())
    latin = [chr(c) for c in range(0xC0, 0x100)]
    words = [f"a{c}b{m}" for c in latin for m in ("", ".", ",.", "&&&", "!?x1", "'s", "-\\9")] + [f"Z{c}" for c in latin]
    words += ["", "x", "<|endoftext|>", "a<|endoftext|>b", "don't", "ª1", "×", "÷a", "\u00a0", "b\u00a0", "\u3000", "]]", "^~`", "é1é", "日本", "a|b", "\U0001f600"]
    texts = [sep.join(words[k::7]) for k in range(7) for sep in (" ", "\n", "\n\n ", " \t", "\u00a0 ", "\r\n")] + [*words, ""]
    for _ in range(2):
        got = []
        for _, at, ids in enc.encode(pa.array(texts)):
            got += [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
        assert got == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    asked = []
    plain, enc._ids = enc._ids, lambda pieces: asked.extend(pieces) or plain(pieces)
    enc.forget()
    list(enc.encode(pa.array(["né queré oui né oui queré oui"])))
    assert sorted(asked) == sorted(["né", " queré", " oui", " né"])  # words after é are pieces of their own


def test_components_reads_links_without_a_shuffle(spark, monkeypatch):
    plans, plain = [], near.settle
    monkeypatch.setattr(near, "settle", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or plain(df, name))
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (5, 5), (7, 9), (9, 7)], "a long, b long").coalesce(1)
    assert {(r["node"], r["root"]) for r in near.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}
    assert [name for name, _ in plans] == ["components", "components"] and "Exchange" not in plans[0][1].replace("Coalesce", "")
