"""The training-data operators against brute force, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import bpe, chat, decontam, langid, lines, pii, quality, queries, simhash, spans, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts, one doc_id twice, no doc_id, and extra columns with names of ours."""
    long = " ".join(f"w{i % 997}" for i in range(30_000)) + "\n" + "x" * 200_000 + " +1 (988) 555-2485"
    passage = " ".join(f"common{i}" for i in range(60))
    rows = [
        (1, None, "en"), (2, "", None), (3, long, "en"), (4, long, "en"), (5, f"a start {passage} one end", "de"), (6, f"other {passage} two", None), (6, f"other {passage} two", None),
        (7, "same line is here\nA short\nSame LINE is here", "fr"), (8, "  same line is here \nelse", "fr"), (None, "same line is here", "fr"), (9, "aaa " * 300, "es"), (10, "é" * 9 + "\n" + "é" * 10 + "\n" + "é" * 10, "es"), (11, "  \t\n ", "es"),
    ]
    df = spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in rows], DOC)
    # names that the operators use themselves
    return df.withColumn("_kept", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("_id", F.lit(2)).withColumn("spans", F.lit(3)).withColumn("cutoffs", F.lit(4)).withColumn("_lost", F.lit(5))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def oracle(name: str):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.sql(queries.ORACLES[name]).df()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    want = oracle(name)
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = [c for c in ("lang", "source", "part", "rank") if c in want.columns and "part" in want.columns] or want.columns[0]
    assert got.sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True).astype(got.dtypes.to_dict()))


def test_quality_counts(spark, odd):
    got = {r["doc_id"]: r for r in quality.judge(odd.where("doc_id <> 6"), spark.createDataFrame([], "doc_id bigint, quality int")).collect()}
    for r in odd.where("doc_id <> 6").collect():
        words = WORD.findall(r["text"] or "")
        grams = list(zip(words, words[1:], words[2:], strict=False))
        seen = collections.Counter(grams)
        rep = {p for i, g in enumerate(grams) if seen[g] > 1 for p in (i, i + 1, i + 2)}
        own = [x for x in (r["text"] or "").split("\n") if WORD.search(x)]
        q = got[r["doc_id"]]
        assert (q["n_words"], q["word_chars"], q["n_dup_lines"], q["n_repeat_words"]) == (len(words), sum(map(len, words)), len(own) - len(set(own)), len(rep))
        assert q["kept"] == (not q["base_failed"])


def test_quality_bound(spark):
    """The binomial tail agrees with a plain sum."""
    from math import comb, exp

    for n, k, p in ((50, 0, 0.05), (400, 3, 0.01), (1000, 9, 0.02)):
        got = spark.range(1).select(quality.log_binomial_tail(F.lit(n), F.lit(k), p)).first()[0]
        assert np.isclose(exp(got), sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_quality_controls_false_rejection(spark):
    """A rule is only used where good documents keep clear of it."""
    rows = [(i, ("fine words here " * 3 + f"u{i} " * 40 if i % 4 else "### $$$ ") + " ".join(f"t{i}x{j}" for j in range(60)) + (" ###$$$%%%&&&***" * 40 if i % 4 == 0 else ""), "en") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    lab = df.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    got = quality.judge(df, lab, quality.Policy(alpha=0.1)).join(lab, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"), F.count("*").alias("n")).collect()
    share = {r["quality"]: r["k"] for r in got}
    assert share.get(1, 1.0) > 0.9 and share[0] < 0.1


def test_lines(spark, odd):
    got = collections.defaultdict(list)
    for r in lines.dedup_lines(odd).collect():
        got[r["doc_id"]].append(r)
    assert got[7][0]["_kept"] == "same line is here\nA short\nSame LINE is here" and got[7][0]["_n_dropped"] == 0
    assert (got[8][0]["_kept"], got[8][0]["_n_lines"], got[8][0]["_n_dropped"]) == ("else", 2, 1)
    assert got[None][0]["_kept"] == "" and got[1][0]["_n_lines"] == 1 and got[2][0]["_kept"] == ""
    assert len(got[6]) == 2 and got[4][0]["_n_dropped"] == 2 and got[10][0]["_n_dropped"] == 0
    clean = lines.clean(odd)
    assert clean.columns == odd.columns and clean.where("doc_id = 1").first()["text"] is None
    # any number of batches and fans gives the same
    a = sorted((r["doc_id"] or -1, r["_kept"]) for r in lines.dedup_lines(odd, batches=1).collect())
    b = sorted((r["doc_id"] or -1, r["_kept"]) for r in lines.dedup_lines(odd, batches=6, fan=3).collect())
    assert a == b


def plain_fingerprint(text: str | None) -> int:
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if hs and sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash(spark, odd, docs):
    for frame in (odd, docs):
        rows = frame.select("doc_id", "text").collect()
        prints = [plain_fingerprint(r["text"]) for r in rows]
        root = list(range(len(rows)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    root[find(i)] = find(j)
        least = {}
        for i, r in enumerate(rows):
            if r["doc_id"] is not None:
                least[find(i)] = min(least.get(find(i), 1 << 62), r["doc_id"])
        want = sorted((str(r["doc_id"]), f"{p:016x}", str(least.get(find(i)))) for i, (r, p) in enumerate(zip(rows, prints, strict=True)))
        got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(frame).collect())
        assert got == want


def test_simhash_crowded_cells(spark):
    """Many close fingerprints are linked by stars; the groups are the same as by all pairs."""
    rng = random.Random(3)
    fps = {0}
    for _ in range(4):
        base = rng.getrandbits(64)
        fps |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id bigint, fp bigint")
    from orrery.llm.common import Workspace

    got = {r["fp"]: r["component_id"] for r in simhash.components(Workspace(spark), df).collect()}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert [got[s] for s in signed] == [find(i) for i in range(len(fps))]


def test_spans(spark, odd, docs):
    for frame in (odd, docs):
        rows = [(r["doc_id"], WORD.findall(r["text"] or "")) for r in frame.select("doc_id", "text").collect()]
        count = collections.Counter(tuple(w[p : p + 35]) for _, w in rows for p in range(len(w) - 34))
        want = []
        for i, w in rows:
            cut = {q for p in range(len(w) - 34) if count[tuple(w[p : p + 35])] > 1 for q in range(p, p + 35)}
            want.append((str(i), len(w), len(cut), sha(" ".join(x for k, x in enumerate(w) if k not in cut))))
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in spans.digest(frame).collect()) == sorted(want)


def plain_pii(text: str | None) -> list[str]:
    def luhn(s):
        d = [int(c) for c in s][::-1]
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0

    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            bad = (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))) or (kind == "phone" and not 9 <= len(digits) <= 15)
            if not bad:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, odd, docs):
    rng = random.Random(3)
    noise = ["".join(rng.choice("0123456789..@+- ()ab%_é-1+") for _ in range(rng.randrange(120))) for _ in range(800)]
    noise += ["1" * 30_000 + " a@b.c.d_e@f.gh a@b.c_d@e.f", "+1 (988) 555-2485 " * 600, "x (at) y (dot) com call 212-555-1234", "4111 1111 1111 1111 and 010.1.1.255"]
    made = spark.createDataFrame(list(enumerate(noise)), "doc_id bigint, text string")
    for frame in (made, odd.where("doc_id <> 6"), docs):
        got = {r["doc_id"]: r for r in pii.digest(frame).collect()}
        for r in frame.select("doc_id", "text").collect():
            want = plain_pii(r["text"])
            g = got[r["doc_id"]]
            assert g["base_sha256"] == sha(",".join(want)) and set(want) <= set(g["spans"].split(",") if g["spans"] else [])
            assert g["n_phone"] == sum(w.startswith("phone") for w in want)


def test_language(spark, odd, docs):
    model = langid.train(docs)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    edge = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert edge[1]["lang_pred"] == edge[2]["lang_pred"] == edge[11]["lang_pred"] == "und" and edge[9]["lang_pred"] != "und"
    none = langid.digest(odd.where("false"))
    assert none.count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train(odd.where("false"))).collect()} == {"und"}


def test_toxicity(spark, odd):
    """Held-out rows with both of two words are told from rows with one of them or none."""
    rng = random.Random(5)
    rows, lab = [], []
    for i in range(1600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"filler{rng.randrange(40)}" for _ in range(12)] + ["insult"] * a + ["people"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        lab.append((i, int(a and b)))
    df, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(lab, "doc_id bigint, toxic int")
    got = toxicity.digest(df, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95
    edge = toxicity.digest(odd, spark.createDataFrame([], "doc_id bigint, toxic int")).collect()
    assert len(edge) == odd.count() and all(0 <= r["score"] <= 1 for r in edge)


def test_bpe(spark, odd, docs):
    import public_tokenizers
    import tiktoken

    path = bpe.default_ranks()
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(1)
    odd_chars = [0x85, 0xA0, 0x180E, 0x200B, 0x2028, 0x3000, 39, 0x1F600, 0x0301]
    made = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.choice(odd_chars), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(rng.randrange(1, 40))) for _ in range(1500)] + ["<|endoftext|> is text", "a" * 120_000 + " b" * 60_000]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    for f in (frame, docs.select("doc_id", "text"), odd.where("doc_id <> 6").select("doc_id", "text")):
        got = {r["doc_id"]: r for r in bpe.round_trip(f).collect()}
        for r in f.collect():
            ids = ref.encode_ordinary(r["text"] or "")
            g = got[r["doc_id"]]
            assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(r["text"] or ""))
    enc = bpe.encode(frame).join(frame, "doc_id").limit(300).collect()
    one = bpe.load(path)
    for r in enc:
        assert one.decode(r["ids"]) == r["text"] and all(0 <= a <= b <= len(r["text"]) for a, b in zip(r["starts"], r["ends"], strict=True))
    assert bpe.decode(bpe.encode_ids(frame)).join(frame, "doc_id").where(F.expr("1 = 1")).count() == len(made)


def test_chat(spark):
    turns = [("user", [{"type": "text", "text": "look <|im_end|> \\ <|"}, {"type": "image", "ref": "s3://x/1.png"}, {"type": "text", "text": "<"}, {"type": "document", "ref": "d", "tokens": 9}]), ("assistant", [{"type": "text", "text": "\\|<|im_start|>"}])]
    body, att = chat.render(turns)
    assert att == [{"kind": "image", "ref": "s3://x/1.png", "tokens": 576}, {"kind": "document", "ref": "d", "tokens": 9}]
    (r1, raw1, _, _), (r2, raw2, a, b) = chat.parse(body)
    assert (r1, r2) == ("user", "assistant") and "<|image:0|>" in raw1 and "<|document:1|>" in raw1
    assert chat.unescape(body[a:b]) == "\\|<|im_start|>" and chat.loss_spans(body) == [(a, b)] and raw2 == body[a:b]
    df = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, None, None, "x"), (2, 0, "assistant", "a\nb")], "conv_id bigint, turn bigint, role string, text string").withColumn("parts", F.lit(7))
    got = {r["conv_id"]: r for r in chat.digest(df).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\nhi\nuser\nhi\nassistant\n\n") and got[1]["loss_chars"] == 0
    assert got[2]["loss_sha256"] == sha("a\nb") and got[None]["turns_sha256"] == sha("\nx\n") and got[-1]["loss_sha256"] == sha(chat.PROBE)


def test_decontamination(spark, odd, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: r["text"].lower().split() for r in bench.collect()}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        w = " " + " ".join(r["text"].lower().split()) + " "
        want |= {(r["doc_id"], i) for i, t in items.items() if " " + " ".join(t) + " " in w}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert len(want) > 0 and len(want & got) >= 0.9 * len(want)
    # what is found beyond verbatim copies has most of the item's words in order
    assert all(r["lcs"] >= 0.75 for r in decontam.contaminated(docs, bench).collect())
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in got}
    assert decontam.contaminated(odd, bench.where("false")).count() == 0 and decontam.contaminated(odd.where("false"), bench).count() == 0
    paraphrase = " ".join(f"filler{i}" for i in range(50))
    t = items[min(items)]
    changed = " ".join(w if k % 8 else "changed" for k, w in enumerate(t))
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6, f"{paraphrase} {changed} {paraphrase}")], "doc_id bigint, text string"))
    assert (10**6, min(items)) in {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench).collect()}


def test_subsequence():
    idf = np.ones(decontam.BUCKETS, np.float32)
    item = decontam.make_item(1, np.array([1, 2, 3, 2, 5], np.uint32), idf)
    assert decontam.common_subsequence(item, [9, 1, 9, 3, 2, 2, 5]) == 4 and decontam.common_subsequence(item, []) == 0


def test_pipeline(spark, docs):
    """run() row by row against a plain chain."""
    import public_tokenizers
    import tiktoken

    import corpus_pipeline

    def base_passes(text):
        words = WORD.findall(text or "")
        grams = list(zip(words, words[1:], words[2:], strict=False))
        seen = collections.Counter(grams)
        rep = {p for i, g in enumerate(grams) if seen[g] > 1 for p in (i, i + 1, i + 2)}
        return len(words) >= 50 and 100 * len(rep) <= 50 * len(words)

    # so few labels certify no cutoff: the base rules decide
    now = {r["doc_id"]: r["text"] for r in docs.collect() if base_passes(r["text"])}
    held, key = {}, lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    for i in sorted(now):
        for line in now[i].split("\n"):
            held.setdefault(key(line), i)
    now = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or held[key(x)] == i) for i, t in now.items()}
    prints, root = {i: plain_fingerprint(t) for i, t in now.items()}, {i: i for i in now}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in now:
        for j in now:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    now = {i: t for i, t in now.items() if find(i) == i}
    terms, df = decontam._Terms(), collections.Counter()
    coded = {i: decontam.tokens(t, terms) for i, t in now.items()}
    for t in coded.values():
        df.update(set(decontam._bucket(t).tolist()))
    idf = np.log((len(now) + 1) / (np.array([df[b] for b in range(decontam.BUCKETS)]) + 1)).astype(np.float32) + np.float32(0.01)
    items = [decontam.make_item(r["item_id"], decontam.tokens(r["text"], terms), idf) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = set()
    for i, t in coded.items():
        for at in decontam.passages(len(t)).tolist():
            for x in items:
                window = decontam._window(t, at, len(x.tokens))
                if len(x.answer.intersection(window)) >= decontam.ANSWER * len(x.answer) and decontam.overlap(x, window) >= decontam.LCS:
                    gone.add(i)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_ranks()), special_tokens={})
    want = {i: (ref.encode_ordinary(t), sha(t)) for i, t in now.items() if i not in gone}
    assert gone and len(want) > 0.6 * docs.count()
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(want) and {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in got} == want
