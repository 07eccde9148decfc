"""The document operators against brute force, on odd rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlog.llm import binary, language, licences, mixing, packing, quality, secrets, simhash, tokens
from tests.conftest import SF
from tests.llm.conftest import odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [tuple(r) for r in df.collect()]


def plain_ids(texts, end):
    own = tokens.tokenizer(tokens.VOCABULARY)[0]
    return [[*x.ids, end] for x in own.encode_batch(["" if t is None else t for t in texts], add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list(" \n\t  　\x85\x1caàé'sb1.,!-|<>語\U0001f600")), max_size=40)), max_size=30))
def test_stretches_encode_like_whole_texts(texts):
    ids, at = tokens.encode(pa.array(texts, pa.string()), tokens.VOCABULARY, 1)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == plain_ids(texts, 1)


def encoded(texts, known=None):
    ids, at = tokens.encode(pa.array(texts, pa.string()), tokens.VOCABULARY, 1, known)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "\n", "\t", " ", "  ", "a", "ab c", "d's", "x.\ny", "\n\n", "", "é\x85"]), max_size=9).map("".join), max_size=12))
def test_special_token_text_stays_whole(texts):
    assert encoded(texts) == plain_ids(texts, 1)


def test_many_batches_with_special_tokens_and_known_stretches():
    rng, parts = random.Random(11), ["<|endoftext|>", "\n", "\t", " ", "a", "the cat", ", ", "<|", "|>", "\r\n", "word", "\n<|endoftext|>\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(10_000)]
    known = tokens.Known(20_000)
    found = [x for k in range(0, len(texts), 7) for x in encoded(texts[k : k + 7], known)]
    assert found == plain_ids(texts, 1) and known.left > -2 * tokens._ENTRY and len(known.ids) > 20
    assert encoded(["a\n<|endoftext|>"])[0] == [64, 198, 50256, 1]


def test_known_stretches_are_compact(monkeypatch):
    words, known, asked = [f"w{chr(97 + k % 26)}{k:04d}" for k in range(2000)], tokens.Known(100_000), []
    each = tokens._encode_each
    monkeypatch.setattr(tokens, "_encode_each", lambda stretches, *more: asked.append(len(stretches)) or each(stretches, *more))
    for texts in ([" ".join(words)], [" ".join(reversed(words))]):
        assert encoded(texts, known) == plain_ids(texts, 1)
    assert len(known.ids) >= 2000 and 0 < known.left and asked[-1] < 10


@given(st.text(alphabet=" \n\t\x1c\x1fab.é\x85\xa0\u1680\u2003\u2028\u3000à©😀", min_size=1, max_size=4))
def test_plain_stretches_by_bytes(x):
    assert tokens._all_plain(pa.array(["a", x, "b c"], pa.large_string())).tolist() == [True, tokens._plain(x), True]


def check_packed(found, texts):
    ids = plain_ids(texts, 1)
    want = Counter((len(x), zlib.crc32(np.array(x, "<u4"))) for x in ids)
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append(r)
        docs[r["doc_id"]].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in own])
        assert [r["offset"] for r in own] == [0, *ends[:-1].tolist()]
        assert ends[-1] == own[0]["context"] <= 2048 and ends[-1] & (ends[-1] - 1) == 0
    assert sum(r["length"] for r in found) == sum(k[0] * n for k, n in want.items())
    return docs, ids


def test_packing(spark, odd, no_docs):
    found = packing.pack_documents(odd).collect()
    docs, _ = check_packed(found, [r[1] for r in odd_rows()])
    by_id = {r[0]: r[1] for r in odd_rows() if r[0] not in (None, 4, 5)}
    for doc, text in by_id.items():
        own, ids = sorted(docs[doc], key=lambda r: r["start"]), np.array(plain_ids([text], 1)[0], "<u4")
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]])
            at += r["length"]
    assert packing.pack_documents(no_docs).count() == 0


def check_steps(found, step):
    """Groups of a task: equal but for one longest sequence, none far from a step's tokens if the task has enough."""
    tokens_of, cost, context = Counter(), Counter(), {}
    for r in found:
        context[r["sequence_id"]] = (r["context"], r["step_group"])
        cost[r["step_group"]] += r["length"] ** 2
    for size, group in context.values():
        tokens_of[group] += size
    tasks = defaultdict(list)
    for group, n in tokens_of.items():
        tasks[group >> 36].append((n, cost[group]))
    for own in tasks.values():
        total, n = sum(x for x, _ in own), len(own)
        assert n == max(1, round(total / step)) and max(x for x, _ in own) - min(x for x, _ in own) <= 2048
        assert n == 1 or all(2 * step / 3 <= x <= 3 * step / 2 for x, _ in own)
    return tasks


def test_step_groups_are_even(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3, "doc_id")
    for step in (1 << 13, 1 << 16):
        tasks = check_steps(packing.pack_documents(docs, step_tokens=step).collect(), step)
        assert sorted(tasks) == [0, 1, 2]
        assert all(max(c for _, c in own) <= 2 * min(c for _, c in own) for own in tasks.values())


def test_steps_are_dealt_as_they_fill(monkeypatch):
    monkeypatch.setattr(packing, "HELD_STEPS", 4)
    steps, out = packing.Steps(1 << 12), []
    for k in range(200):
        context = (2048, 256, 1024, 512)[k % 4]
        steps.add(context, [(k, 0, context)], [(k, context)])
        out += steps.dealt(False)
    assert steps.tokens < 4 << 12 and len(out) > 100
    out += steps.dealt(True)
    sizes = Counter()
    for _, context, group in out:
        sizes[group] += context
    assert sorted(k for k, *_ in out) == list(range(200)) and max(sizes.values()) <= 1.5 * min(sizes.values()) and set(sizes) == set(range(len(sizes)))


def test_mixing_near_targets(spark, odd, no_docs):
    found = mixing.taken(odd).collect()
    assert len(found) == len(odd_rows())
    sizes = sorted(len(WORD.findall(r[1] or "")) for r in odd_rows())
    assert sorted(r["size"] for r in found) == sizes
    by = defaultdict(lambda: [0, 0, 0])
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        own = by[(r["source_size"], r["target"])]
        own[0] += r["taken"]
    assert abs(sum(t for _, t in by) - sum(sizes)) < 1e-6
    for (size, target), own in by.items():
        assert target <= 3 * size + 1e-9 and abs(own[0] - target) <= 2
    assert mixing.taken(no_docs).count() == 0


@pytest.mark.parametrize("blocks", [16, 512])
def test_mixing_sources_below_half_a_block(spark, blocks):
    def docs(source, n, words):
        return [(" ".join(["w"] * words), f"s{source:04}") for _ in range(n)]

    held = docs(1000, 40, 500) + [x for source in range(30) for x in docs(source, 3, 2 + source % 5)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(held)], "doc_id bigint, text string, source string")
    found = mixing.taken(df, blocks=blocks).join(df.select("doc_id", "source"), "doc_id").collect()
    by = defaultdict(lambda: [0, 0.0])
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    assert len(by) == 31 and all(own > 0 and abs(own - target) <= max(1, 0.02 * target) for own, target in by.values())
    total = sum(own for own, _ in by.values())
    assert abs(total - sum(r["size"] for r in found)) <= 0.02 * total


def test_mixing_reruns_agree(odd):
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, mixing.taken(odd).collect())) == sorted(map(key, mixing.taken(odd.repartition(3)).collect()))


def same_as_sql(docs, **of):
    plain = lambda rs: sorted((tuple("" if x is None or x != x else f"{float(x):.6f}" if isinstance(x, (int, float)) else str(x) for x in r) for r in rs), key=str)
    own = duckdb.connect()
    own.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    found = mixing.taken(docs, **of).collect()
    assert plain(map(tuple, found)) == plain(own.execute(mixing.oracle(**of)).fetchall())
    return found


@pytest.mark.parametrize("of", [{}, {"blocks": 700, "shards": 5}, {"blocks": 40, "shards": 3}, {"blocks": 700, "seed": 3, "weights": (1, 9), "most": 2}])
def test_mixing_equals_sql(odd, of):
    same_as_sql(odd, **of)


def test_shards_draw_their_quotas(spark):
    """Each shard's words of a source are its quota of blocks but for the documents at its ends; another number of shards deals them anew."""
    docs = spark.createDataFrame([(k, " ".join(["w"] * (1 + k * 7 % 5)), f"s{k % 3}") for k in range(9000)], "doc_id bigint, text string, source string")
    first, other = same_as_sql(docs, blocks=900, shards=6), same_as_sql(docs, blocks=900, shards=4)
    assert sorted(r["taken"] for r in first) == sorted(r["taken"] for r in other) and {r["shards"] for r in first} != {r["shards"] for r in other}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    aims = mixing.targets(docs.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("source_size")))
    width = mixing.measured_in_blocks(aims, 900).first()["width"]
    names = {r["rank"]: r["source"] for r in aims.collect()}
    asked = {(names[r["rank"]], r["shard"]): r["blocks"] * width for r in mixing.quotas(aims, 900, 6).collect()}
    got = Counter()
    for r in first:
        for k, shard in enumerate(filter(None, r["shards"].split(","))):
            got[source[r["doc_id"]], int(shard)] += min(r["size"], r["taken"] - k * r["size"])
    assert set(got) == set(asked) and all(abs(got[x] - asked[x]) <= 5 for x in asked)
    drawn = [r["doc_id"] for r in first if source[r["doc_id"]] == "s1" and r["taken"]]
    assert len(drawn) > 100 and drawn != sorted(drawn)


def test_rows_that_are_alike_share_a_line(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    docs = spark.createDataFrame([(None, "a b c", "hot")] * 300 + [(1, "x y", "hot")] * 40 + [(k, "p q r s", "b") for k in range(50)], "doc_id bigint, text string, source string")
    found = same_as_sql(docs, blocks=100, shards=4)
    assert len(found) == 390 and sum(r["size"] == 3 for r in found) == 300
    words, took = mixing.mix(docs).agg(F.sum(mixing.n_words(F.col("text")))).first()[0], sum(r["taken"] for r in found)
    assert took - 340 <= words <= took  # rows that are alike share what they take, whole words each


def test_mix_keeps_columns_with_any_names(spark):
    docs = spark.createDataFrame([(k, "a b c d", "s", "x", 1, 2, 3) for k in range(9)], "doc_id bigint, text string, source string, mix_row string, mix_row_ int, MIX_TEXT int, `a.b` int")
    out = mixing.mix(docs)
    assert out.columns == docs.columns and {tuple(r)[3:] for r in out.collect()} == {("x", 1, 2, 3)}


def test_mix_takes_what_it_says(odd, no_docs):
    out = mixing.mix(odd).collect()
    assert set(out[0].asDict()) == set(odd.columns)
    took, said = Counter(), Counter()
    for r in out:
        took[r["source"]] += len(WORD.findall(r["text"]))
        assert any((t[1] or "").startswith(r["text"]) for t in odd_rows() if t[0] == r["doc_id"])
    for r in mixing.taken(odd).collect():
        said[r["source_size"]] += r["taken"]
    assert abs(sum(took.values()) - sum(said.values())) <= 2
    assert mixing.mix(no_docs).count() == 0


def test_first_words(spark):
    texts = [" a  b\nc d ", "a b", "x"]
    df = spark.createDataFrame([(t, n) for t in texts for n in range(4)], "t string, n int")
    for r in df.select("t", "n", mixing.first_words(F.col("t"), F.col("n")).alias("p")).collect():
        assert r["t"].startswith(r["p"]) and len(WORD.findall(r["p"])) == min(r["n"], len(WORD.findall(r["t"])))


def plain_print(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + n]).encode(), 42) for k in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abAZé語 \n\t ")), max_size=80), max_size=12))
def test_fingerprints(texts):
    assert simhash.fingerprints(pa.array([*texts, None, prose(9, 700)], pa.string())).tolist() == [plain_print(t) for t in [*texts, None, prose(9, 700)]]


@pytest.mark.parametrize("seed", range(4))
def test_links_are_exact(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (600, 5)).astype(np.uint64), axis=1) * (rng.random(600) < 0.9).astype(np.uint64)
    prints = np.unique(rng.choice(base, 600) ^ flips)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4

    def classes(edges):
        up = np.arange(len(prints))
        while True:
            new = up.copy()
            for a, b in edges:
                new[a] = new[b] = min(new[a], new[b])
            if (new == up).all():
                return up.tolist()
            up = new

    want = classes(np.argwhere(near).tolist())
    assert classes(simhash.link(prints, None, 4)) == want
    half = len(prints) // 2
    forest = [*simhash.link(prints[:half], None, 4), *[(a + half, b + half) for a, b in simhash.link(prints[half:], None, 4)], *simhash.link(prints[:half], prints[half:], 4)]
    assert classes(forest) == want and len(simhash.link(prints, None, 4)) < len(prints)


def test_near_duplicates(spark, odd, no_docs, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 3)  # many tiles and slots
    found = simhash.near_duplicates(odd).collect()
    own = [(r[0], plain_print(r[1])) for r in odd_rows()]
    prints = np.array([p for _, p in own], np.uint64)
    group = np.arange(len(own))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    for _ in own:
        group = np.array([group[near[k]].min() for k in range(len(own))])
    want = []
    for (doc, p), g in zip(own, group, strict=True):
        ids = [d for (d, _), x in zip(own, group, strict=True) if x == g and d is not None]
        want.append((doc, f"{p:016x}", min(ids) if ids else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, found)) == sorted(map(key, want))
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(group.tolist()))
    assert len({plain_print(r["text"]) for r in kept.collect()}) == len(set(group.tolist()))
    assert simhash.keep_one(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k + 1, k) for k in range(40)] + [(200 + k, 100) for k in range(50)] + [(7, 3)]
    found = dict(rows(simhash.components(spark.createDataFrame(edges, "u bigint, v bigint"))))
    assert found == {**{k: 0 for k in range(1, 41)}, **{200 + k: 100 for k in range(50)}}


BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)
SECRETS = [
    'Password: hunter22 token=abc token="abcdef" 😀 secret = xxxxxx APIKEY:\'k+/_.=-1\' API_KEY==abcdefg',
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " xAKIAAKIA" + "C" * 12,
    "token: deadbeefdeadbeefdeadbeefdeadbeef0 " + "f" * 24 + "g" + "e" * 23,
    "secretpasswd:token:abcdef -----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20 + " xoxb-1234567890-ab eyJhbGciOiJI.eyJzdWIiOiIx.sig AIza" + "x" * 35,
    "", None, "tok en = abcdef", "TOKEN=ABCDEF\npasswd\t=abcdef",
]


def test_secrets(spark, odd, no_docs):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(SECRETS)], "doc_id bigint, text string").unionByName(odd.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100))
    found = secrets.digest(secrets.scan(docs, bucket_rows=7)).collect()
    texts = {**dict(enumerate(SECRETS)), **{100 + r[0]: r[1] for r in odd_rows() if r[0] not in (None, 5)}}
    assert len(found) == docs.count()
    for r in found:
        if r["doc_id"] not in texts:
            continue
        own = [(m.start(), k, m.end()) for k, (_, p, good) in enumerate(BASE) for m in p.finditer(texts[r["doc_id"]] or "") if good(m)]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in own) for k in range(3)]
        said = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(own))
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and set(said.split(",")) - {""} <= set(r["spans"].split(","))
    assert {x.split(":")[0] for x in next(r for r in found if r["doc_id"] == 3)["spans"].split(",")} == {"hex", "key_block", "forge", "chat", "web_token", "cloud"}
    assert secrets.digest(secrets.scan(no_docs)).count() == 0


def test_secrets_equal_sql(spark, odd):
    """Odd texts, letters that fold to ASCII ones, and random mixtures of the rules' parts."""
    rng, parts = random.Random(7), ["token", "Secret", "\u017fecret", "to\u212aen", "api_key", "=", ": ", '"', "'", "abcdef", "abc", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", "\n", " ", "\u00e9\U0001f600", "ghp_", "xoxb-", "AIza", "eyJabcdefgh", ".", "-----BEGIN PRIVATE KEY-----"]
    texts = [*SECRETS, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(400))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    own = duckdb.connect()
    own.register("documents", pa.table({"doc_id": pa.array([r["doc_id"] for r in docs.collect()], pa.int64()), "text": pa.array([r["text"] for r in docs.collect()], pa.string())}))
    want = own.execute(secrets.oracle())
    names, want = [x[0] for x in want.description], want.fetchall()
    found = secrets.digest(secrets.scan(docs))
    key = lambda r: tuple(map(str, r))
    assert found.columns == names and sorted(map(key, found.collect())) == sorted(map(key, want))
    assert all(sum(r[k] for r in want) > 5 for k in (1, 2, 3)) and sum("web_token" in r[5] for r in want) > 0


def test_redact(spark, odd, no_docs):
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(SECRETS)], "doc_id bigint, text string, n_chars int")
    out = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert len(out) == len(SECRETS) and out[5]["text"] is None and out[6]["text"] == SECRETS[6]
    for k, text in enumerate(SECRETS):
        marks = np.zeros(len(text or ""), bool)
        for s in secrets.scan(docs.where(f"doc_id = {k}")).first()["spans"]:
            marks[s["start"] : s["end"]] = True
        want = "".join("\0" if m else c for c, m in zip(text or "", marks))
        assert re.sub("\0+", "[secret]", want) == (out[k]["text"] or "")
    kept = secrets.redact(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() and secrets.redact(no_docs).count() == 0


def test_secrets_of_texts_with_very_many_matches(spark):
    text = "".join(f"é token=abcdef{k} " if k % 3 else f"{k:024x}{'AKIA' + 'X' * 16}|" for k in range(20_000))
    docs = spark.createDataFrame([(-(2**63), text), (None, "token=abcdef"), (None, "nothing here"), (7, "token=")], "doc_id bigint, text string")
    found = {(r["doc_id"], r["n_assign"]): r for r in secrets.digest(secrets.scan(docs)).collect()}
    own = [(m.start(), k, m.end()) for k, (_, p, good) in enumerate(BASE) for m in p.finditer(text) if good(m)]
    row = next(r for (d, _), r in found.items() if d == -(2**63))
    assert row["base_sha256"] == hashlib.sha256(",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(own)).encode()).hexdigest()
    assert (None, 1) in found and (None, 0) in found and (7, 0) in found
    out = next(r["text"] for r in secrets.redact(docs).collect() if r["doc_id"] == -(2**63))
    marks = np.zeros(len(text), bool)
    for a, _, b in own:
        marks[a:b] = True
    assert out == re.sub("\0+", "[secret]", "".join("\0" if m else c for c, m in zip(text, marks)))


def test_only_possible_candidates_meet_the_index(spark):
    docs = spark.createDataFrame([(k, f"plain text number {k}" if k % 10 else f"password: abcdef{k}") for k in range(500)], "doc_id bigint, text string")
    small, may = secrets.candidates(docs, bucket_rows=50)
    assert small.count() == docs.where(may(F.col("text"))).count() == 50
    plan = secrets.redact(docs.withColumn("sec_key", F.lit("x")).withColumn("SEC_OUT", F.lit("y")))
    assert {(r["sec_key"], r["SEC_OUT"]) for r in plan.collect()} == {("x", "y")} and plan.where("text like '%[secret]'").count() == 50


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        x = [(k * 7919) % 23 - 5 for k in range(n)]
        df = spark.createDataFrame([(x,)], "x array<bigint>")
        sums, tops = df.select(secrets.running(F.col("x"), lambda a, b: a + b), secrets.running(F.col("x"), lambda a, b: F.when(a.isNotNull(), F.greatest(a, b)))).first()
        assert sums == np.cumsum(x, dtype=int).tolist() and tops == np.maximum.accumulate(np.array(x, int)).tolist()


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]{24,}") == [] and secrets.trigram_query("a?bc") == []
    assert secrets.trigram_query("AKIA[A-Z0-9]{16,}") == [[["aki", "kia"]]]
    assert secrets.trigram_query("(foob|barx)+z") == [[["foo", "oob"], ["arx", "bar"]]]
    assert secrets.trigram_query("(foob|ba)z") == [[["foo", "obz", "oob"], ["baz"]]]
    assert secrets.trigram_query(r"(?i:Key\.x|abc)+\d[=:]{2}end$") == [[["ey.", "key", "y.x"], ["abc"]], [["end"]]]
    assert secrets.trigram_query("abcd|xyz") == [[["abc", "bcd"], ["xyz"]]] and secrets.trigram_query("(abc)?") == []


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 100, 16384, 40001])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32 if n % 2 else 50257, n, dtype=np.uint32)
    index, planes = binary.compress(ids, kind, 1 << 14)
    assert np.array_equal(binary.expand(n, index, planes, kind, 1 << 14), ids)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_store(spark, odd, no_docs, tmp_path, kind):
    binary.write_tokens(odd, f"{tmp_path}/{kind}", kind=kind, chunk_ids=500)
    found = sorted(binary.read_tokens(spark, f"{tmp_path}/{kind}").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in odd_rows()), key=lambda x: -1 if x is None else x)
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    want = Counter((len(x), zlib.crc32(np.array(x, "<u4"))) for x in plain_ids([r[1] for r in odd_rows()], 2))
    assert Counter((r["n_tokens"], r["ids_crc32"]) for r in found) == want
    least = spark.createDataFrame([(-(2**63), "x"), (None, "y"), (3, "a\n<|endoftext|>")], "doc_id bigint, text string")
    binary.write_tokens(least, f"{tmp_path}/least")
    assert [r["doc_id"] for r in sorted(binary.read_tokens(spark, f"{tmp_path}/least").collect(), key=lambda r: r["start"])] == [None, -(2**63), 3]
    binary.write_tokens(no_docs, f"{tmp_path}/none")
    assert binary.read_tokens(spark, f"{tmp_path}/none").count() == 0


def duck(docs, sql):
    own = duckdb.connect()
    own.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    return sorted((tuple(str(x) if x is not None and x == x else "" for x in r) for r in own.execute(sql).fetchall()), key=str)


def test_licences(odd, no_docs, spark):
    texts = ["Released under the MIT License.\nMore", "released UNDER the  mit license", "Text. Licensed under the Apache License, Version 2.0. Text", "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", licences.TEMPLATES[13][2].replace("free of charge", "without charge"), "All rights", "A.\nAll rights reserved."]
    docs = odd.select("doc_id", "text", "source").unionByName(spark.createDataFrame([(900 + k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, source string"))
    found = licences.scan(docs)
    own = {r["doc_id"]: r for r in found.collect()}
    assert [own[900 + k]["licenses"] for k in range(len(texts))] == ["mit", "mit", "apache-2.0", "", "cc-by-nc-4.0,mit", "mit", "", "reserved"]
    assert [own[900 + k]["allowed"] for k in range(len(texts))] == [True, True, True, True, False, True, True, False]
    plain = sorted((tuple(str(x) if x is not None else "" for x in r) for r in found.collect()), key=str)
    fix = lambda rs: sorted(((a, b, c, f"{float(d):.9f}", e) for a, b, c, d, e in rs), key=str)
    assert fix(plain) == fix(duck(docs, licences.oracle()))
    assert licences.scan(no_docs).count() == 0


def test_wrapped_and_mid_line_licences(spark):
    wording = {name: text for name, _, text in licences.TEMPLATES}  # the last of each, the long ones of mit, gpl-3.0 and apache-2.0

    def wrap(text, mark, every=7):
        own = text.split(" ")
        return "".join(f"{mark}{' '.join(own[k : k + every])}\n" for k in range(0, len(own), every))

    around = prose(7, 300), prose(8, 300)
    texts = {mark: [f"{around[0]}\n{mark}\n{wrap(wording[name], mark)}{mark}\n{around[1]}" for name in ("mit", "gpl-3.0", "bsd", "isc", "apache-2.0")] for mark in ("", "# ", " * ", "// ")}
    cases = [(t, name) for own in texts.values() for t, name in zip(own, ("mit", "gpl-3.0", "bsd", "isc", "apache-2.0"), strict=True)]
    cases += [
        ("Copyright 2020 Foo, all rights reserved", "reserved"),
        (f"{around[0]} and this was released under the MIT License by {around[1]}", "mit"),
        (f"{around[0]}\nThis work is licensed under\nthe GNU General\nPublic License, version 3.", "gpl-3.0"),
        ("one two three licensed under the Apache\nLicense, Version 1.1. four five six", ""),
        ("he has all rights and reserved a seat; " * 50, ""),
        ("all rights reserved by foo, " * 3000, "reserved"),
        (f"{around[0]}\n\n{wrap(' '.join(wording['gpl-3.0'].split(' ')[10:]), '')}\n{around[1]}", "gpl-3.0"),  # a shortened notice of several lines
    ]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    assert [found[k]["licenses"] for k in range(len(cases))] == [name for _, name in cases]
    assert all(found[k]["allowed"] == (name not in ("gpl-3.0", "reserved")) and found[k]["n_matches"] == (name != "") for k, (_, name) in enumerate(cases))


def test_language(spark, odd, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, prototypes = language.learn(docs)
    met = language.predict(docs, langs, prototypes).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(met) > 30 and sum(r["lang"] == r["lang_pred"] for r in met) >= 0.95 * len(met)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in met)
    found = language.predict(odd, langs, prototypes).collect()
    assert len(found) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["lang_pred"] for r in found if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert language.learn(no_docs)[0] == [] and {r["lang_pred"] for r in language.predict(odd, *language.learn(no_docs)).collect()} == {"und"}


def plain_language(docs, held):
    """Trigram by trigram in plain Python."""
    own = np.random.default_rng(language.SEED).integers(0, 2, (language.SYMBOLS + 1, language.SIZE), dtype=np.int8) * 2 - 1

    def vector(text):
        symbols = []
        for c in f" {(text or '').lower()} ":
            x = ord(c) % language.SYMBOLS + 1 if c.isalpha() else 0
            if x or not symbols or symbols[-1]:
                symbols.append(x)
        out = np.zeros(language.SIZE, np.int64)
        for (a, b, c), n in Counter(zip(symbols, symbols[1:], symbols[2:])).items():
            out += round(16 * (1 + np.log(n))) * (np.roll(own[a], 2) * np.roll(own[b], 1) * own[c]).astype(np.int64)
        return out / np.sqrt((out.astype(float) ** 2).sum()) if out.any() else out.astype(float)

    vectors = [vector(t) for _, t, _ in docs]
    langs = sorted({lang for (_, t, lang), h in zip(docs, held) if lang is not None and t is not None and not h})
    sums = np.array([sum(np.rint(v.astype(np.float32) * 65536) for v, (_, t, x), h in zip(vectors, docs, held) if x == lang and t is not None and not h) for lang in langs])
    sums /= np.linalg.norm(sums, axis=1, keepdims=True)
    sums -= sums.mean(axis=0)
    sums /= np.linalg.norm(sums, axis=1, keepdims=True)
    out = []
    for v in vectors:
        cosine = sums @ v
        out.append((langs[int(cosine.argmax())], (1 + cosine.max()) / 2) if v.any() else ("und", 0.0))
    return out


def test_language_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"] or "") < 6000][:90]
    docs += [(1000, None, "en"), (1001, "12 !", "en"), (1002, "x", "de"), (1003, "hello there world of words", None)]
    held = [zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in docs]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    found = [sorted(rows(language.predict(x, *language.learn(x)))) for x in (df.coalesce(1), df.repartition(5))]
    assert found[0] == found[1]  # to the last bit, however the input is split
    for (doc, own_held, lang, score), (want, near), h in zip(found[0], plain_language(docs, held), held, strict=True):
        assert (own_held, lang) == (h, want) and abs(score - near) < 1e-5, doc


def test_language_does_not_see_held_out_rows(spark, odd):
    hidden = odd.where(language.held_out(F.col("doc_id")))
    assert language.learn(hidden)[0] == []


def test_trigram_counts():
    text, gram, count = language.trigrams(["ab ab", "", "1 2", "a"])
    assert text.tolist() == [0, 0, 0, 3] or (Counter(text.tolist()) == {0: 4, 3: 1})
    assert count[text == 3].tolist() == [1] and count[text == 0].sum() == 5


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abé#| \n\t語")), max_size=60), max_size=8))
def test_counts(texts):
    found = quality.count(pa.array([*texts, None], pa.string()))
    assert [[int(found[c][k]) for c in quality.COUNTS[:5]] for k in range(len(texts) + 1)] == [plain_counts(t) for t in [*texts, None]]


def test_quality(spark, odd, no_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    found = quality.judged(odd, quality.fit(odd, labels)).collect()
    own = lambda r: [r[c] for c in quality.COUNTS[:5]]
    assert sorted(map(own, found)) == sorted(plain_counts(r[1]) for r in odd_rows())
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in found)
    assert quality.judged(no_docs, []).count() == 0 and quality.keep_good(no_docs, labels).count() == 0


def test_decision_list_finds_thresholds():
    rng = np.random.default_rng(5)
    rows_ = {k: rng.random(3000) for k in ("a", "b", "c")}
    bad = (rows_["a"] > 0.8) & (rows_["b"] < 0.5) | (rows_["c"] > 0.95)
    rules = quality.learn(rows_, bad)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= quality._covers(rule, rows_, 3000)
    assert 2 <= len(rules) <= 8 and (hit & bad).sum() > 0.85 * bad.sum() and (hit & ~bad).sum() < 0.02 * bad.sum()


def test_decision_list_on_labels(spark):
    docs, labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    met = quality.judged(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in met if r["quality"] == 1]
    poor = [r["kept"] for r in met if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(poor) <= 0.5 * len(poor)
