"""Each stage of the pipeline, on what the stage before it kept, against SQL or a brute-force version of its own."""

import hashlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from playwatch.llm import oracle
from playwatch.llm import probminhash as pmh
from tests.llm.test_llm import words

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, __words int, size int, doc string, its_doc int"


def stages(spark, docs):
    """Rows that each stage was given and gave."""
    out = []
    for _, stage in corpus_pipeline.STAGES:
        # a plain table, as the pipeline has it
        given = corpus_pipeline.written(docs, "given")
        docs = corpus_pipeline.written(stage(spark, given, SF), "kept")
        out.append((given, docs))
    return out


@pytest.fixture(scope="module")
def run(spark):
    return stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def sql(given, query):
    documents = given.toArrow()  # noqa: F841 (DuckDB reads it by name)
    return duckdb.sql(query).fetchall(), duckdb.sql(query).columns


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_quality_rules_keep_what_sql_keeps(run):
    given, kept = run[0]
    rows, columns = sql(given, oracle.QUALITY)
    at = columns.index("kept")
    assert ids(kept) == Counter(r[0] for r in rows if r[at]) and 0 < kept.count() < given.count()
    assert kept.subtract(given).count() == 0


def test_line_dedup_keeps_the_lines_that_sql_keeps(run):
    given, kept = run[1]
    rows, columns = sql(given, oracle.LINES)
    digest = columns.index("kept_sha256")
    got = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in kept.collect()}
    assert got == {r[0]: r[digest] for r in rows}
    assert all(r.n_chars == len(r.text) for r in kept.collect())


def test_near_duplicates_keep_one_document_of_each_class(run):
    given, kept = run[2]
    hashes = pmh.WordHashes()
    docs = sorted((r.doc_id, r.text or "") for r in given.collect())
    sets = [pmh.shingles(hashes.of(words(t))) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and pmh.probability_jaccard(*sets[i], *sets[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert ids(kept) == Counter(docs[k][0] for k in set(label)) and kept.count() < given.count()
    assert kept.subtract(given).count() == 0


def test_mixing_takes_documents_as_often_as_sql_takes_them(run):
    given, kept = run[3]
    rows, columns = sql(given, oracle.MIXING)
    size, taken = columns.index("size"), columns.index("taken")
    got = ids(kept)
    assert all(got[r[0]] == r[taken] // r[size] for r in rows if r[size])
    assert kept.subtract(given).count() == 0


def test_bpe_encodes_what_the_mix_took_as_the_library_does(run):
    given, kept = run[4]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in given.collect():
        own = lib.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(own), sha(" ".join(map(str, own))), sha(lib.decode(own, skip_special_tokens=False)))] += 1
    assert Counter(tuple(r) for r in kept.collect()) == want


def test_stages_hold_with_nulls_repeats_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(40))
    other = [" ".join(f"{a}{i}" for i in range(50)) for a in "abcdefgh"]
    texts = [long, long, long + " x", None, "", " \n", "\n".join([long] * 2), "é " * 10 + long, *other] * 2
    rows = [(None if i % 5 == 4 else i // 2, t, "en", None if i % 3 else "s", 1, "r", 1, 2, "d", 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ODD)
    for given, kept in stages(spark, docs)[:4]:
        assert kept.columns == docs.columns and 0 < kept.count()
        assert {tuple(r) for r in kept.select("row", "__words", "size", "doc", "its_doc").collect()} == {("r", 1, 2, "d", 3)}
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(0), SF).count() == 0
