"""Every operator against a brute-force version on small fixtures with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from playwatch.llm import ann, line_dedup, mixing, near_dup, quality, repeats, token_count, token_output, toxicity, word_bpe
from playwatch.llm import probminhash as pmh

DOCS = "doc_id long, text string, source string, __words string, left string, h long"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t", "a", "<|endoftext|> x", "ΑΣ ﬁ É 12 漢字 😀", "x" * 2000, "it's 'll DON'T", "a\r\nb\x1cc", "  b", "word " * 700]


def frame(spark, texts, ids=None, source=None):
    ids = ids or range(len(texts))
    rows = [(i, t, source(i) if source else "s", "w", "l", 1) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_token_counts_and_output_equal_the_library(spark, tmp_path):
    lib = Tokenizer.from_file(BYTE)
    ids = [lib.encode(t or "", add_special_tokens=False).ids for t in ODD]
    df = frame(spark, ODD)
    got = rows(token_count.token_counts(df, BYTE, limit=600), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == sorted(((i, len((t or "").encode()), len(x), len(x) > 600) for i, (t, x) in enumerate(zip(ODD, ids, strict=True))), key=str)
    token_output.write_tokens(df, BYTE, 2, str(tmp_path / "o"), block_ids=50)
    want, start = [], 0
    for i, x in enumerate(ids):
        want.append((i, start, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes()), [*x, 2]))
        start += len(x) + 1
    back = token_output.read_tokens(spark, str(tmp_path / "o"), with_ids=True)
    assert rows(back, "doc_id", "start", "n_tokens", "ids_crc32", "ids") == sorted(want, key=str)
    token_output.write_tokens(df.limit(0), BYTE, 2, str(tmp_path / "e"))
    assert token_output.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_packed_ids_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 999):
        x = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        lengths, back = token_output.read_block(token_output.block_bytes(np.array([n], np.uint32), x))
        assert (x == back).all() and lengths.tolist() == [n]


def test_word_bpe_equals_the_library(spark):
    lib = Tokenizer.from_file(WORD)
    got = {r.doc_id: (r.ids, r.decoded) for r in word_bpe.word_bpe(frame(spark, ODD), WORD, digests=False).collect()}
    for i, t in enumerate(ODD):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, lib.decode(ids, skip_special_tokens=False)), t
    assert word_bpe.word_bpe(frame(spark, []), WORD).count() == 0


def test_word_bpe_random_texts_equal_the_library():
    rng, lib, codec = random.Random(2), Tokenizer.from_file(WORD), word_bpe.WordCodec(WORD)
    parts = ["abc", "É", "'s", "'LL", "１２", "²", " ", "\n", " ", "!?", "Σ", "İ", "é", "<|startoftext|>", "ab" * 200]
    for _ in range(500):
        t = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert codec.encode(t) == lib.encode(t, add_special_tokens=False).ids, t


def test_lines(spark):
    long = "This very line is longer than forty characters, isn't it"
    texts = [long, f"x\n {long.upper()}\t\ny", long, f"{long}\n{long}", f"a\n{long}", long, None, "", "short\n" * 6, long]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 5]
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.deduped_lines(frame(spark, texts, ids)).collect()}
    assert got == {(0, 1, 1, ""), (1, 3, 1, "x\ny"), (2, 1, 1, ""), (3, 2, 2, ""), (4, 2, 1, "a"), (5, 1, 0, long), (6, 1, 0, ""), (7, 1, 0, ""), (8, 7, 0, "short\n" * 6)}
    kept = line_dedup.without_dropped_lines(frame(spark, texts, ids))
    assert kept.columns == ["doc_id", "text", "source", "__words", "left", "h"] and kept.count() == 10
    many = "\n".join([f"unique line number {i} that is certainly long enough to count" for i in range(300)] + [long])
    five = frame(spark, [many] + [long] * 5)
    assert rows(line_dedup.deduped_lines(five), "doc_id", "n_dropped")[0] == (0, 1)
    assert line_dedup.deduped_lines(frame(spark, [])).count() == 0


def brute_quality(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("ab cd ef\ng # $".split(" "), k=rng.randint(0, 60))) for _ in range(60)] + ODD
    got = rows(quality.quality_verdicts(frame(spark, texts)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((i, *brute_quality(t)) for i, t in enumerate(texts)), key=str)
    good = " ".join(f"word{i}" for i in range(30))
    mixed = frame(spark, [good] * 40 + ["bad"] * 60, source=lambda i: None if i >= 30 else "fine")
    kept = {r.doc_id for r in quality.quality_verdicts(mixed).filter("kept").collect()}
    assert kept == set(range(30))  # the null host fails as a whole
    assert {r.doc_id for r in quality.kept_documents(mixed).collect()} == kept
    assert quality.quality_verdicts(frame(spark, [])).count() == 0


def test_mixing(spark):
    rng = random.Random(4)
    texts = ["w " * rng.randint(0, 60) for _ in range(400)] + [None, ""]
    df = frame(spark, texts, source=lambda i: [None, "a", "b", "c"][min(3, i % 11)])
    got = mixing.mixed(df).collect()
    assert sorted(tuple(r) for r in mixing.mixed(df).select("doc_id", "taken").collect()) == sorted((r.doc_id, r.taken) for r in got)
    taken, target, size = Counter(), {}, {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    assert all(abs(taken[s] - target[s]) <= 31 and target[s] <= 2 * size[s] for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    copies = Counter(r.doc_id for r in mixing.mixed_documents(df).collect())
    assert all(copies[r.doc_id] == r.taken // r.size for r in got if r.size)
    assert mixing.mixed(frame(spark, [])).count() == 0


def test_mixing_takes_documents_without_words_as_often_as_their_source_whole(spark):
    texts = [["w " * 30, "w w", None, "", " \n"][i % 5] for i in range(200)]
    df = frame(spark, texts, source=lambda i: [None, "a", "b", "c"][min(3, i % 11)])
    copies = Counter(r.doc_id for r in mixing.mixed_documents(df).collect())
    got = mixing.mixed(df).collect()
    assert all(copies[r.doc_id] == (r.taken // r.size if r.size else r.target // r.source_size) for r in got)
    assert any(copies[r.doc_id] for r in got if not r.size)


def test_the_mix_meets_targets_with_null_and_repeated_ids(spark):
    ten = "w " * 10
    cases = {
        "null ids, one text": ([ten] * 100, [None] * 100),
        "null ids, many texts": ([f"w{i} " * 10 for i in range(100)], [None] * 100),
        "one id, one text": ([ten] * 99 + [ten], [5] * 99 + [6]),
        "one id, many texts": ([f"w{i} " * 10 for i in range(60)] + [ten] * 40, [5] * 100),
        "one id, many sizes": (["w " * (i % 7 + 4) for i in range(140)], [5] * 70 + [None] * 70),
    }
    for name, (texts, ids_) in cases.items():
        df = frame(spark, texts, ids_)
        total = sum(len(words(t)) for t in texts)
        took = sum(r.taken for r in mixing.mixed(df).collect())
        got = mixing.mixed_documents(df).collect()
        assert sum(len(words(r.text)) for r in got) == took and abs(took - 1.5 * total) <= 10, name
        assert max(Counter((r.doc_id, r.text) for r in got).values()) <= 2 * max(Counter(zip(ids_, texts, strict=True)).values()), name
        assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mixed_documents(df.repartition(3)).collect())), name
    assert mixing.mixed_documents(frame(spark, [])).count() == 0


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(5)
    off = []
    for _ in range(40):
        u = rng.integers(1, 2**63, 40, dtype=np.uint64)
        a, b = np.sort(u[:30]), np.sort(u[8:])
        wa, wb = rng.integers(1, 4, 30), rng.integers(1, 4, 32)
        x, y = dict(zip(a.tolist(), wa.tolist(), strict=True)), dict(zip(b.tolist(), wb.tolist(), strict=True))
        want = sum(1 / sum(max(x.get(i, 0) / x[d], y.get(i, 0) / y[d]) for i in {*x, *y}) for d in x if d in y)
        exact = pmh.probability_jaccard(a, wa, b, wb)
        assert abs(exact - want) < 1e-9
        s = pmh.signatures(np.r_[a, b], np.r_[wa, wb], np.array([30, 32]), 256)
        off.append((s[0] == s[1]).mean() - exact)
    assert abs(np.mean(off)) < 0.03


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 9999)}" for _ in range(120)] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(rng.randint(1, 9)):
            w = list(b)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 9999)}"
            texts.append(" ".join(w))
    texts += [texts[0]] * 3 + [None, "", " ", "one two", "one  two", "one two three"]
    hashes = pmh.WordHashes()
    sets = [pmh.shingles(hashes.of(words(t))) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and pmh.probability_jaccard(*sets[i], *sets[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = sorted((i, find(i)) for i in range(len(texts)))
    df = frame(spark, texts)
    assert rows(near_dup.near_duplicates(df), "doc_id", "class_id") == sorted(want, key=str)
    assert {r.doc_id for r in near_dup.first_of_classes(df).collect()} == {c for _, c in want}
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_large_buckets_meet_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 2)
    rng = random.Random(7)
    b = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(12):
        w = list(b)
        w[rng.randrange(100)] = f"n{rng.random()}"
        texts.append(" ".join(w))
    assert {r.class_id for r in near_dup.near_duplicates(frame(spark, texts)).collect()} == {0}


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 10)).astype(np.float32)
    x[500:900] = x[0]
    vectors = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 1), (5100, [0.0] * 10, 1), (5200, [float("nan")] * 10, 1), (5300, [1.0, None] * 5, 1), (None, [1.0] * 10, 1), (5400, [1.0], 1)]
    got = ann.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, code int")).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(range(0, 3000, 100))
    d, hits = x.astype(float), 0
    for q, near in found.items():
        s = np.sqrt(((d - d[q]) ** 2).sum(1))
        s[q] = np.inf
        want = np.lexsort((np.arange(len(s)), s))[:10]
        hits += len({*want.tolist()} & {i for i, _ in near})
        assert all(abs(v - s[i]) < 1e-12 for i, v in near) and near == sorted(near, key=lambda p: (p[1], p[0]))
    assert hits >= 0.97 * 10 * len(found)
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert len(ann.nearest(spark.createDataFrame(vectors[:3], "vec_id long, embedding array<float>, c int")).collect()) == 2


def test_nearest_in_a_cluster_denser_than_codes_resolve(spark):
    rng = np.random.default_rng(18)
    x = rng.normal(size=(10_000, 16))
    hot = rng.permutation(10_000)[:3300]
    x[hot] = x[hot[0]] + 1e-3 * rng.normal(size=(len(hot), 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(1)
    found = {}
    for r in sorted(ann.nearest(rows, every=200).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(range(0, 10_000, 200)) and {*found} & {*hot.tolist()}
    for q, near in found.items():
        s = np.sqrt(((x - x[q]) ** 2).sum(1))
        s[q] = np.inf
        assert near == np.lexsort((np.arange(len(s)), s))[:10].tolist()


def test_toxicity_learns_and_keeps_to_its_fold(spark):
    rng = random.Random(9)
    plain = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.3
        w = rng.choices(plain, k=60) + (rng.choices(["grubhead", "grubface", "snotling"], k=3) if bad else [])
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    df = frame(spark, [*texts, None, ""])
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, table).collect()}
    truth = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    assert got[900].score == got[901].score and got[900].predicted == 0
    out = [i for i, r in got.items() if r.held_out and i in truth]
    assert sum(got[i].predicted == truth[i] for i in out) >= 0.95 * len(out)
    none = toxicity.toxicity(df, table.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.0]


def brute_repeats(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for i, b in enumerate(raw):
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mask[k : k + length] = True
        left = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        out.append((i, len(b), int(mask.sum()), int((np.diff(np.r_[False, mask].astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    para = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(n))
    pool = [para(60) for _ in range(5)]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.randint(1, 5)):
            x = rng.choice(pool)[rng.randint(0, 60) :]
            k = rng.randint(0, len(x))
            t.append(rng.choice([x, x[:k] + "z" + x[k:], para(rng.randint(0, 30))]))
        texts.append("".join(t))
    texts += [None, "", "a" * 500, "ab" * 300, "\0" * 450, pool[0] * 2, texts[3], "q" * 199, "é" * 150]
    got = rows(repeats.without_repeats(frame(spark, texts)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats(texts)
    assert repeats.without_repeats(frame(spark, [])).count() == 0


def test_repeats_of_a_hash_with_many_contexts_are_dealt_out(spark, monkeypatch):
    rng = random.Random(5)
    para = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    line, shared = para(190), [para(rng.randint(5, 60)) for _ in range(6)]
    texts = [para(150) + rng.choice(shared) + line[: rng.choice([120, 185, 190])] + rng.choice(shared) + para(150) for _ in range(60)]
    texts += ["a" * 500, "ab" * 300, line * 3, "é" * 150, texts[0], None]
    groups, covered = [], repeats.covered

    def seen(contexts, length):
        groups.append(contexts.groupBy("h").count().agg({"count": "max"}).first()[0] or 0)
        return covered(contexts, length)

    monkeypatch.setattr(repeats, "covered", seen)
    monkeypatch.setattr(repeats, "SORTED_ROWS", 10)
    got = rows(repeats.without_repeats(frame(spark, texts)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats(texts)
    assert max(groups) <= 10
    # and every hash so, on other texts
    monkeypatch.setattr(repeats, "SORTED_ROWS", 0)
    texts = texts[:30] + ["\0" * 450, texts[3] * 2, "q" * 199]
    got = rows(repeats.without_repeats(frame(spark, texts)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats(texts)


def test_contexts_that_are_dealt_out_are_not_broadcast(spark, monkeypatch):
    rng = random.Random(6)
    line = "".join(rng.choices("abcdefgh ", k=190))
    texts = [f"{i:030d}{line}{i % 7:030d}" for i in range(50)]
    plans, written = [], repeats.written

    def seen(df, name):
        if name == "met":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(repeats, "written", seen)
    monkeypatch.setattr(repeats, "SORTED_ROWS", 10)
    got = rows(repeats.without_repeats(frame(spark, texts)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats(texts)
    # the join of contexts with their keys is part of the plan of the strings that meet
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_first_of_classes_tells_rows_of_no_or_one_id_apart(spark):
    rng = random.Random(12)
    a, b, c, d, e = ([f"{x}{rng.randrange(10**6)}" for _ in range(60)] for x in "abcde")
    text = lambda words, *more: " ".join([*words, *more])
    docs = [
        (1, text(a)), (None, text(a, "x")), (None, text(a)),  # null ids in a class that has an id
        (None, text(b)), (None, text(b)), (None, text(b, "y")), (None, text(c)),  # classes of null ids only
        (7, text(d)), (7, text(d, "z")), (7, text(e)), (7, text(e)),  # an id with texts of one class and of another
        (None, None), (None, ""), (None, " "), (8, ""), (9, "\t"),
    ]
    got = near_dup.first_of_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    kept = Counter((r.doc_id, (r.text or "")[:1].strip()) for r in got)
    # no words: null and empty texts of no id are one, a blank is another text
    assert kept == Counter({(1, "a"): 1, (None, "b"): 1, (None, "c"): 1, (7, "d"): 1, (7, "e"): 1, (None, ""): 2, (8, ""): 1, (9, ""): 1})


def test_ids_and_words_of_all_letters_equal_the_library():
    from playwatch.llm.pretokens import PretokenTable

    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    table, codec = PretokenTable(BYTE, list), word_bpe.WordCodec(WORD)
    for c in range(0x20000):
        if not 0xD800 <= c < 0xE000:
            t = f"A{chr(c)}b {chr(c)}1"
            assert [i for v in table.values_of(t) for i in v] == byte.encode(t, add_special_tokens=False).ids, hex(c)
            assert codec.encode(t) == word.encode(t, add_special_tokens=False).ids, hex(c)


def test_columns_split_as_the_library_splits():
    import pyarrow as pa

    from playwatch.llm.pretokens import SPLIT, pretoken_lists

    rng, splitter = random.Random(5), Tokenizer.from_file(BYTE).pre_tokenizer
    below = [chr(c) for c in range(0x250) if c not in (0x85, 0xA0)]
    parts = ["'", "s", "t", "re", "ve", "ll", "r", "l", "e", "'S", " ", "  ", "\n", "\t", "\0", "\x1c", "a", "é", "ɏ", "1", "²", "?", "×", "«"]
    mixed = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(20_000)]
    texts = ["", *(f"{a}{c}{b}" for c in below for a in ("", "a", " ", "\n", "1", "'") for b in ("", "a", " ", "  b", "?", "'s")), *mixed, ""]
    column = pa.array(["dropped", *texts])[1:]
    got = pretoken_lists(column).to_pylist()
    assert got == [SPLIT.findall(t) for t in texts]
    assert got == [[t[a:b] for _, (a, b) in splitter.pre_tokenize_str(t)] for t in texts]
    assert pretoken_lists(pa.array([], pa.string())).to_pylist() == [] and pretoken_lists(pa.array(["", ""])).to_pylist() == [[], []]


def test_a_column_encodes_each_of_its_pretokens_once(monkeypatch):
    import pyarrow as pa

    from playwatch.llm.pretokens import ColumnTable, PretokenTable

    lib, seen, make = Tokenizer.from_file(BYTE), [], PretokenTable.make
    monkeypatch.setattr(PretokenTable, "make", lambda self, word: seen.append(word) or make(self, word))
    monkeypatch.setattr(PretokenTable, "__getitem__", lambda self, word: pytest.fail("a lookup for each occurrence"), raising=False)
    table = ColumnTable(BYTE, token_output.ids_of_two_bytes)
    texts = ["the end. " * 500 + "it's", None, "", "the end."] * 20
    for _ in range(2):
        got = table.joined(pa.array(texts)).to_pylist()
        assert got == [token_output.ids_of_two_bytes(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert sorted(seen) == sorted({"the", " the", " end", ".", " it", "'s"})


def test_a_task_of_op1_splits_no_plain_text_by_itself(spark, monkeypatch):
    import pyarrow as pa

    from playwatch.llm.pretokens import PretokenTable

    # what encoded gives to each task, run here
    class Given(Exception):
        pass

    def give(self, run, schema):
        raise Given(run)

    df = frame(spark, ["a"])
    monkeypatch.setattr(type(df), "mapInArrow", give)
    with pytest.raises(Given) as given:
        token_output.encoded(df, BYTE, 2)
    lib, split, words_of = Tokenizer.from_file(BYTE), [], PretokenTable.words
    monkeypatch.setattr(PretokenTable, "words", lambda self, piece: split.append(piece) or words_of(self, piece))
    texts = [f"it's the end of {i % 7}. " for i in range(900)] + ["漢字 " * 3, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(902)), pa.array(texts)], ["doc_id", "text"])
    got = pa.Table.from_batches(list(given.value.args[0](iter([batch]))))
    assert got["doc_id"].to_pylist() == list(range(902))
    want = [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in got["ids"].to_pylist()] == want
    assert split == ["漢字 " * 3]


def test_columns_of_any_texts_equal_the_library_within_their_bound():
    import pyarrow as pa

    from playwatch.llm.pretokens import ColumnTable

    rng, lib, table = random.Random(6), Tokenizer.from_file(BYTE), ColumnTable(BYTE, token_output.ids_of_four_bytes, limit=50)
    parts = [" ", "\n", "'s", "x", "É", "Σ", "漢", "\x85", "\xa0", "\u2003", "<|endoftext|>", "😀"]
    for _ in range(60):
        texts = [*ODD, *("".join(rng.choices([*parts, f" w{rng.randint(0, 999)}"], k=rng.randint(0, 12))) for _ in range(20))]
        want = [token_output.ids_of_four_bytes(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
        for kind in (pa.string(), pa.large_string()):
            assert table.joined(pa.array(texts, kind)).to_pylist() == want
        table.trim()
        assert len(table.known) == len(table.values) == len(table.uses) <= 50
    assert table.joined(pa.array([], pa.string())).to_pylist() == []


def test_parts_of_a_batch_hold_all_rows_and_little_text():
    import pyarrow as pa

    texts = [None, "", "é" * 30, "a" * 5, None, "b" * 100, "", "c" * 5, "d" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["doc_id", "text"])
    for size in (1, 10, 64, 1000):
        parts = list(token_output.parts_of(batch, size))
        assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
        assert all(sum(len((t or "").encode()) for t in p["text"].to_pylist()[:-1]) <= size + 100 for p in parts)
    assert sum(p.num_rows for p in token_output.parts_of(batch.slice(0, 0))) == 0


def test_tables_of_a_worker_stay_within_their_bound_and_right():
    from playwatch.llm.pretokens import PretokenTable

    lib, table = Tokenizer.from_file(BYTE), PretokenTable(BYTE, list, limit=20)
    rng = random.Random(3)
    for _ in range(200):
        t = " ".join(f"w{rng.randint(0, 99)}" for _ in range(10)) + " — the"
        assert [i for v in table.values_of(t) for i in v] == lib.encode(t, add_special_tokens=False).ids
        # a text's own pre-tokens come on top
        assert len(table) <= 20 + 32 and len(table.old) <= 20 + 32


def test_rows_of_no_doc_id_and_repeated_rows(spark, tmp_path):
    lib = Tokenizer.from_file(BYTE)
    texts, ids = ["b b", "a", "b b", None, "a", "long " * 3000], [None, 7, 7, None, 7, 1]
    df = frame(spark, texts, ids)
    token_output.write_tokens(df, BYTE, 2, str(tmp_path / "o"))
    back = token_output.read_tokens(spark, str(tmp_path / "o"), with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in back] == [1, 7, 7, 7, None, None]
    assert Counter(tuple(r.ids) for r in back) == Counter((*lib.encode(t or "", add_special_tokens=False).ids, 2) for t in texts)
    at = 0
    for r in back:
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.doc_id, r.n_tokens) for r in token_count.token_counts(df, BYTE).collect()) == Counter((r.doc_id, r.n_tokens - 1) for r in back)
    assert word_bpe.word_bpe(df, WORD).count() == quality.quality_verdicts(df).count() == 6
    near = near_dup.near_duplicates(df).collect()
    assert len(near) == 6 and Counter(r.class_size for r in near) == Counter({1: 2, 2: 4})
    assert sorted((r.doc_id or -1, r.n_removed) for r in repeats.without_repeats(df).collect())[2] == (1, 15_000)
    lines = Counter((r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.deduped_lines(df).collect())
    assert lines == Counter({(None, 1, 0): 2, (7, 1, 0): 3, (1, 1, 0): 1})
    assert sum(r.taken for r in mixing.mixed(df).collect()) >= 0


def test_links_are_counted_and_hubs_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "STAR", 3)
    rng = random.Random(17)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i in range(14):
        own = list(base)
        own[rng.randrange(120)] = f"n{i}"
        texts.append(" ".join(own))
    got = near_dup.near_duplicates(frame(spark, [*texts, "something else that stands alone here"])).collect()
    assert {(r.doc_id, r.class_id) for r in got} == {(i, 0) for i in range(15)} | {(15, 15)}
    assert sum(r.n_links for r in got) >= 2 * 14 and [r.n_links for r in got if r.doc_id == 15] == [0]
    # registers of a pair at the threshold fall short by SLACK about once in 10 ** 10
    from math import comb

    n, most = near_dup.REGISTERS, int((0.8 - near_dup.SLACK) * near_dup.REGISTERS)
    assert sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(most)) < 1e-9


def test_documents_beyond_a_chunk_of_places(spark, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    assert_chunked = repeats.Anchors(200)
    text = "".join(rng.choices("abcdefgh ", k=5000)).encode()
    at, found = assert_chunked.of(text)
    monkeypatch.setattr(repeats, "CHUNK", 1 << 20)
    whole, hashes = repeats.Anchors(200).of(text)
    assert at.tolist() == whole.tolist() and found.tolist() == hashes.tolist()
    monkeypatch.undo()
    seam = "".join(rng.choices("abcdefgh ", k=300))
    big = "".join(rng.choices("abcdefgh ", k=(1 << 20) + 5000))
    texts = [big[: (1 << 20) - 100] + seam + big[(1 << 20) - 100 :], "x" + seam + "y", None]
    got = rows(repeats.without_repeats(frame(spark, texts)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    cut = lambda t: hashlib.sha256(t.replace(seam, "").encode()).hexdigest()
    assert got == [(0, len(texts[0]), 300, 1, cut(texts[0])), (1, 302, 300, 1, cut(texts[1])), (2, 0, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_groups_are_maximal_repeats_with_all_occurrences():
    rng = random.Random(2)
    core = "".join(rng.choices("abcd", k=50)).encode()
    # left sides (last byte first) and right sides of one anchor: three share 50 bytes around it, two of them 52; the last shares 48
    left = [b"xyzab", b"xyzcd", b"xyqqq", b"zzz"]
    right = [core[:49] + b"1", core[:49] + b"2", core[:48] + b"33", core[:48] + b"44"]
    got = sorted((sorted(m.tolist()), a, b) for m, a, b in repeats.repeat_groups(np.zeros(4, np.int64), left, right, 50))
    assert got == [([0, 1], 3, 49), ([0, 1, 2], 2, 48)]


def nearest_by_force(rows_, every, k=10):
    """(query_id, rank, vec_id, score) of every query over all rows but those of its own id; a query's vector is the least of its id's."""
    names, x = np.array([i for i, _ in rows_]), np.array([v for _, v in rows_], float)
    out = []
    for q in sorted({i for i in names.tolist() if i % every == 0}):
        vector = np.array(min(v for i, v in rows_ if i == q), float)
        other = names != q
        far, own = np.sqrt(((x[other] - vector) ** 2).sum(1)), names[other]
        out += [(q, n + 1, int(own[i]), float(far[i])) for n, i in enumerate(np.lexsort((own, far))[:k].tolist())]
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_nearest_with_repeated_ids_and_copies(spark, monkeypatch, partitions):
    rng = np.random.default_rng(31)
    x = np.round(rng.normal(size=(4000, 12)), 3).tolist()
    rows_ = list(enumerate(x))
    rows_ += [(0, x[0])] * 20 + [(1000, x[0]), (7, x[0])]  # a query's id 21 times, and two exact copies of it under other ids
    rows_ += [(400, x[400])] * 10 + [(401, x[400])] * 50 + [(402, x[400])]  # k + 1 rows of a query's id, then 50 copies of one other id
    rows_ += [(800, x[9]), (800, x[10]), (5, x[800]), (1, x[1])]  # an id of three vectors
    rows_ += [(i, x[1200]) for i in range(5000, 5030)] * 2 + [(1200, x[1200])] * 49
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>").repartition(partitions)
    want, found = nearest_by_force(rows_, 400), []
    for batch, shard in (("100", 64 << 20), ("10000", 12 * 8 * 300)):
        monkeypatch.setattr(ann, "SHARD_BYTES", shard)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found.append(sorted(map(tuple, ann.nearest(df, every=400, block=4).collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r[:3] for r in found[0]] == [r[:3] for r in want] == [r[:3] for r in found[1]]
    assert np.allclose([r[3] for r in found[0]], [r[3] for r in want], rtol=0, atol=1e-12)
    assert [r[2] for r in want if r[0] == 0][:2] == [7, 1000] and [r[2] for r in want if r[0] == 400] == [401] * 10


def plain_features(text, lexicon):
    """FEATURES by their definitions, word by word."""
    words = re.findall(r"\w+", text)
    lower = [w.lower() for w in words]
    n, size = max(len(words), 1), max(len(text), 1)
    second = [w in toxicity.SECOND for w in lower]
    whole = [lexicon.get(w) for w in lower]
    five, four = ([lexicon.get(w[:k] + "-") for w in lower] for k in (5, 4))
    count = lambda xs: sum(x is not None for x in xs)
    hit = [any(x is not None for x in v) for v in zip(whole, five, four, strict=True)]
    near = sum(h and any(second[max(i - 5, 0) : i + 6]) for i, h in enumerate(hit))
    marks = sum(not re.match(r"[\w \n]", c) for c in text)
    return [
        math.log1p(len(words)), count(whole) / n, math.log1p(count(whole)), count(five) / n, math.log1p(count(five)), count(four) / n,
        max([0.0, *(x for v in (whole, five, four) for x in v if x is not None)]), sum(second) / n, near / n,
        sum(c.isupper() for c in text) / size, sum(w.isupper() and len(w) > 2 for w in words) / n, text.count("!") / size, text.count("?") / size,
        marks / size, len(toxicity.OBFUSCATED.findall(text)) / n,
    ]


def test_toxicity_features_equal_their_definitions():
    lexicon = {"grub": 3.0, "grubh-": 2.5, "grub-": 1.0, "snot-": 4.0, "ÿß": 0.5}
    rng = random.Random(4)
    pieces = ["grub", "GRUBHEAD", "snotty", "You", "du", "plain", "wort", "!", "?!", "\n", " ", "a.b-c d", "sh1t", "$$$", "Ça", "ÿß", "sooooo", "x_y", "\t", "\u3000", "𝒳"]
    for text in ["", " ", "!", "you grub", *("".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(60))) for _ in range(300))]:
        assert toxicity.features(text, lexicon) == pytest.approx(plain_features(text, lexicon)), text


def test_toxicity_of_few_labels_long_texts_and_no_documents(spark):
    texts = [f"calm words number {i} of a day" for i in range(30)] + [f"you grubhead number {i}" for i in range(20)]
    df = frame(spark, [*texts, "grubhead plain " * 200_000], [*range(50), 1000])
    learns = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1]
    toxic = [i for i in learns if i >= 30]
    assert len(toxic) > 3
    for bad in (toxic, toxic[:2], toxic[:1], []):
        labels = spark.createDataFrame([(i, int(i in bad)) for i in learns if i < 30 or i in bad], "doc_id long, toxic int")
        got = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
        assert len(got) == 51 and all(0 <= r.score <= 1 for r in got.values())
        if len(bad) < 2:
            known = sum(i < 30 for i in learns) + len(bad)
            assert {r.score for r in got.values()} == {len(bad) / known}
    labels = spark.createDataFrame([(i, int(i >= 30)) for i in learns], "doc_id long, toxic int")
    assert toxicity.toxicity(df.limit(0), labels).count() == 0


def test_copies_of_a_text_are_one_part(spark):
    df = frame(spark, ["same insult"] * 40 + [f"other {i}" for i in range(20)] + [None, "", "b", "a"], [*range(60), 70, 71, 80, 80])
    labels = spark.createDataFrame([(i, int(i < 40)) for i in (*range(60), 70, 71, 80)], "doc_id long, toxic int")
    rows = toxicity.training_rows(df, labels, 1000).collect()
    assert len(rows) == len({r.doc_id for r in rows}) and "b" not in {r.text for r in rows}
    assert len({(r.part, r.judge) for r in rows if r.text == "same insult"}) == 1
    assert {r.judge for r in rows if r.toxic == 0} == {True, False} and len({r.part for r in rows if r.toxic == 0}) > 1
    few = toxicity.training_rows(df, labels, 7).count()
    assert few <= 7


def test_toxicity_features_and_labels(spark):
    df = frame(spark, ["You are a GRUBHEAD!!", None, "", "plain words"], [1, 2, None, 1])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert Counter(r.doc_id for r in got) == Counter({1: 2, 2: 1, None: 1})


def test_a_session_elsewhere_must_name_the_shared_folder():
    from playwatch.llm.common import shared_dir

    class Elsewhere:
        conf = type("conf", (), {"get": staticmethod(lambda name, default=None: default)})
        sparkContext = type("context", (), {"master": "spark://there:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Elsewhere())
