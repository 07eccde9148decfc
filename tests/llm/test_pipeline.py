"""The pipeline's stages on the given tables and on odd ones; the registered queries of the operators."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from loomlog.llm import mixing, quality, queries, secrets, simhash
from loomlog.llm.shared import materialize
from tests.conftest import SF
from tests.llm.conftest import prose
from tests.llm.test_documents import WORD, plain_counts, plain_ids, plain_print


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, columns, texts = [docs.count()], docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        counts.append(docs.count())
        if name != "pack":
            assert docs.columns == columns
            texts[name] = docs.toPandas()
    good, single, clean, mixed = (texts[x] for x in ("quality_rules", "near_dedup", "secret_scan", "source_mix"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    short = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len((r["text"] or "").split()) < 50}
    assert not short & set(good["doc_id"])
    missing = [d for d in labels[labels == 1].index if d not in set(good["doc_id"]) and d not in short]
    assert len(missing) <= 0.05 * len(labels)
    groups = simhash.near_duplicates(spark.createDataFrame(good)).toPandas()
    assert set(single["doc_id"]) == set(groups["component_id"]) and single["doc_id"].is_unique
    assert set(clean["doc_id"]) == set(single["doc_id"])
    assert secrets.scan(spark.createDataFrame(clean)).where("size(spans) > 0").count() == 0
    assert set(mixed["doc_id"]) <= set(clean["doc_id"]) and mixed.groupby("doc_id").size().max() <= 4
    words = lambda t: sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in t)
    assert abs(words(mixed["text"]) - words(clean["text"])) < 0.02 * words(clean["text"])
    assert docs.agg({"length": "sum"}).first()[0] > 0 and docs.select("doc_id").distinct().count() == mixed["doc_id"].nunique()


def fixture_rows():
    """Good prose, shouted spam, copies, near copies, short and null texts and secrets, of three sources, one of them hot."""
    rows = []
    for k in range(150):
        text = prose(k, 60 + 3 * k)
        if k % 5 == 1:
            text = re.sub(r"[.\n]", "!! ", text).upper()
        if k % 15 == 7:
            text += f'password = "letmein{k}" and AKIA{k:016d} too {k:032x}'
        rows.append((k, text, "en", "hot" if k % 3 else "cold", len(text)))
    for k in range(150, 170):  # copies of a text, and of another with one word changed
        text = rows[40][1] if k % 2 else rows[142][1].replace(" ", f" x{k} ", 1)
        rows.append((k, text, None, "mirror", len(text)))
    return [*rows, (170, None, "en", "hot", None), (171, "short", "en", None, 5), (172, "", "en", "cold", 0)]


def plain_ratios(text):
    """quality.RATIOS of a text, counted anew."""
    n_words, word_chars, n_symbols, dup, repeated = plain_counts(text)
    letters, per = len(re.findall("[A-Za-z]", text)), max(1, n_words)
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    share = lambda pattern: len(re.findall(pattern, text)) / per
    return {
        "words": n_words, "word_length": word_chars / per, "symbols_a_word": n_symbols / per, "repeated_lines": dup / max(1, lines), "repeated_words": repeated / per,
        "upper_case": len(re.findall("[A-Z]", text)) / max(1, letters), "marks_a_word": share("[!?]"), "digits_a_word": share("[0-9]"), "distinct_words": len(set(WORD.findall(text))) / per,
    }


def plain_good(text, rules):
    own = plain_ratios(text or "")
    n_words, _, _, _, repeated = plain_counts(text)
    met = any(all(own[name] >= limit if side == ">=" else own[name] <= limit for name, side, limit in rule) for rule in rules)
    return n_words >= 50 and 100 * repeated <= 50 * n_words and not met


def plain_heads(docs):
    """The smallest doc_id of each group of texts that are linked by fingerprints."""
    prints = np.array([plain_print(r[1]) for r in docs], np.uint64)
    near, group = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4, np.array([r[0] for r in docs])
    for _ in docs:
        group = np.array([group[x].min() for x in near])
    return [r for r, g in zip(docs, group, strict=True) if r[0] == g]


def plain_redacted(text):
    marked = np.zeros(len(text), bool)
    for rule in secrets.RULES:
        for m in re.finditer(rule.pattern, text):
            if len(m[rule.group]) >= rule.least:
                marked[m.start() : m.end()] = True
    return re.sub("\0+", "[secret]", "".join("\0" if m else c for c, m in zip(text, marked)))


def plain_mixed(docs):
    """What the SQL of the mix takes, told out: (doc_id, text) of each time."""
    own = duckdb.connect()
    own.register("documents", pa.table({"doc_id": [r[0] for r in docs], "text": [r[1] for r in docs], "source": pa.array([r[3] for r in docs], pa.string())}))
    texts, out = {r[0]: r[1] for r in docs}, []
    for doc_id, size, taken in own.execute(f"SELECT doc_id, size, taken FROM ({mixing.oracle()})").fetchall():
        out += [(doc_id, texts[doc_id])] * (taken // size)
        if taken % size:
            after = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", texts[doc_id])]
            out.append((doc_id, texts[doc_id][: after[taken % size - 1]]))
    return out


def test_stages_equal_brute_force(spark):
    """The whole chain, each stage on what the one before it kept."""
    rows, schema = fixture_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    labels = spark.createDataFrame([(k, int(k % 5 != 1), 0) for k in range(150)], "doc_id bigint, quality int, toxic int")
    rules = quality.fit(docs, labels)
    good = [r for r in rows if plain_good(r[1], rules)]
    assert rules and {r[0] for r in good if r[0] < 150} == {k for k in range(150) if k % 5 != 1}
    docs = materialize(quality.keep_good(docs, labels), "good")
    assert sorted(map(tuple, docs.collect()), key=lambda r: r[0]) == good
    single = plain_heads(good)
    assert len(good) - len(single) >= 18
    docs = materialize(corpus_pipeline.near_dedup(spark, docs, SF), "single")
    assert sorted(map(tuple, docs.collect()), key=lambda r: r[0]) == single
    clean = [(k, text := plain_redacted(t), lang, source, len(text)) for k, t, lang, source, _ in single]
    assert sum(a != b for a, b in zip(clean, single)) >= 5
    docs = materialize(corpus_pipeline.secret_scan(spark, docs, SF), "clean")
    assert sorted(map(tuple, docs.collect()), key=lambda r: r[0]) == clean
    mixed = plain_mixed(clean)
    docs = materialize(corpus_pipeline.source_mix(spark, docs, SF), "mixed")
    assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter(mixed) and all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    want, got = defaultdict(list), Counter()
    for (doc_id, _), ids in zip(mixed, plain_ids([t for _, t in mixed], 1)):
        want[doc_id].append(np.array(ids, "<u4"))
    for r in corpus_pipeline.pack(spark, docs, SF).collect():
        got[r["doc_id"]] += r["length"]
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for x in want[r["doc_id"]])
    assert got == {k: sum(map(len, x)) for k, x in want.items()}


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_stages_take_odd_tables(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.count() > 0 and (name == "pack" or docs.columns == odd.columns)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_run_over_whole_tables(spark, name):
    table = {"op7_urls": "pages", "op9_neighbours": "embeddings"}.get(name, "documents")
    rows, n = queries.QUERIES[name](spark, SF).count(), spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert rows >= n if name in ("op1_packing", "op9_neighbours") else rows == n
