"""Conversation repair, decontamination and periodic runs against brute force."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np

from playwatch.llm import conversation_repair, decontaminate, periodic, queries

DOCS = "doc_id long, text string, source string, uid string, words string, n long"
CONVERSATIONS = "conv_id long, turn long, role string, text string, present string, signature long"


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "s", "u", "w", 1) for i, t in zip(ids, texts, strict=True)], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digests(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# periodic runs


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if i > s and size >= max(24, 3 * q):
                own = w[s : s + size]
                if not any(own[d:] == own[: size - d] for d in range(1, q)):
                    out.append((s, size, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    w = []
    for _ in range(rng.randint(0, 6)):
        few = rng.choice([1, 2, 50])
        part = [rng.randint(0, few) for _ in range(rng.randint(1, 40))]
        w += (part * rng.randint(1, 8))[: rng.randint(1, 200)] if rng.random() < 0.5 else part if rng.random() < 0.8 else part[:2] * 20
    return w


def test_runs_equal_brute_force():
    rng, met = random.Random(1), set()
    for _ in range(1200):
        w = random_words(rng)
        want = brute_runs(w)
        met |= {q for _, _, q in want}
        assert periodic.runs_of(np.array(w, np.int32)) == want
    assert {1, 2, 16, 17} <= met and max(met) > 32
    assert periodic.runs_of(np.zeros(50_000, np.int32)) == [(0, 50_000, 1)]


def test_grams_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(periodic, "mix", lambda x: x * np.uint64(0))
    rng = random.Random(2)
    for _ in range(100):
        w = random_words(rng)
        assert periodic.runs_of(np.array(w, np.int32)) == brute_runs(w)


def brute_periodic(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        a, g = (h // 10) % len(w), h // 10
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *own, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs(spark):
    rng = random.Random(3)
    texts = [rng.choice([" ", "\n", " \t"]).join(f"w{x}é" for x in random_words(rng)) for _ in range(300)]
    texts += [None, "", " \n", "a\x1cb\x85c " * 30, "ab " * 9000, "x" * 70_000]
    ids = [*range(len(texts) - 3), None, 7, 7]
    got = periodic.run_digests(periodic.periodic_runs(periodic.with_planted_periods(frame(spark, texts, ids))))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [brute_periodic(i, t) for i, t in zip(ids, texts, strict=True)]
    assert digests(got) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want if w[0] is not None and zlib.crc32(str(w[0]).encode()) % 10 == 0) > 5
    assert periodic.periodic_runs(frame(spark, [])).count() == 0


# decontamination


def compared(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = compared(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = compared(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                owners = windows.get(tuple(w[i : i + n]))
                if owners:
                    hit |= set(range(i, i + n))
                    found |= owners
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


def test_contamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    some = lambda n: [rng.choice(["the", "of", "É", "10x"] + [f"w{k}" for k in range(40)]) for _ in range(n)]
    items = [(i, " ".join(some(rng.randint(8, 40)))) for i in range(60)]
    items += [(100, None), (101, ""), (102, "Zed"), (103, "zed yes"), (104, "q1 q2 q3 q4"), (5, "again five " + items[5][1]), (None, "no item has this name but it hits"), (105, items[0][1])]
    docs = []
    for i in range(200):
        w = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            own = compared(rng.choice(items)[1])
            cut = rng.randint(0, max(0, len(own) - 9))
            at = rng.randint(0, len(w))
            w[at:at] = own[cut : cut + rng.randint(5, 25)]
        docs.append((i, "".join(x.upper() + rng.choice([" ", "-", "\n", "\x00", "?! "]) for x in w) if i % 3 else " ".join(w)))
    docs += [(200, None), (201, ""), (202, "!?"), (203, "ZED"), (7, "q1 q2 q3 q4 q1 q2 q3"), (None, items[3][1]), (None, items[3][1]), (204, (items[9][1] + " ") * 400)]
    documents = frame(spark, [t for _, t in docs], [i for i, _ in docs])
    benchmark = spark.createDataFrame([(i, t, "w", 2) for i, t in items], "item_id long, text string, words string, hash long")
    want = sorted(brute_contamination(docs, items), key=str)
    assert digests(decontaminate.contamination_digests(decontaminate.contamination(documents, benchmark))) == want
    # a bitmap that lets nearly all through, and documents of many rows of places
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 64)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 64)
    monkeypatch.setattr(decontaminate, "ROW_SPOTS", 3)
    found = decontaminate.contamination(documents, benchmark)
    assert digests(decontaminate.contamination_digests(found)) == want
    assert digests(decontaminate.contamination_digests(decontaminate.contamination(documents, benchmark.limit(0)))) == sorted(((d, len(compared(t)), 0, 0, sha(""), False) for d, t in docs), key=str)
    assert decontaminate.contamination(documents.limit(0), benchmark).count() == 0


# conversation repair


def cheapest(rows):
    """(cost, audit, repaired) of (initial, fault, role, text) rows by Dijkstra's algorithm over all edits."""
    follow = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, out = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(out)
        if at < len(rows):
            fault, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, out))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if (last, role[:1]) in follow:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, role[:1], (*out, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    if (last, other[0]) in follow:
                        heapq.heappush(heap, (cost + extra + 3, audit + "R", at + 1, other[0], (*out, f"{other}:{text}")))
        for other in ("user", "assistant"):
            if (last, other[0]) in follow:
                heapq.heappush(heap, (cost + 3, audit + "I", at, other[0], (*out, f"{other}:")))


def brute_repairs(rows):
    out, by = [], {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for conv, own in by.items():
        kept = []
        for _, turn, role, text in own:
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if h == 0:
                continue
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            kept += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        turns = {t for t, _, _ in kept if t is not None}
        faults, seen = [], set()
        for _, role, text in kept:
            bare = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        cost, audit, text = cheapest([(f, r, t) for f, (_, r, t) in zip(faults, kept, strict=True)])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha(text)))
    return sorted(out, key=str)


def conversation_rows(rng):
    rows = []
    for conv in [*range(400), None]:
        for turn in range(rng.choice([1, 2, 3, 5, 8, 9])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "sys", "User"])
            text = rng.choice(["Yes.", "No", "What?", "fine! \n", None, "", " \t", "x" * 3000 + ".", "é…", "ok.", f"t{rng.random()}."])
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), role, text))
    return rows


def test_repairs_equal_brute_force(spark):
    rng = random.Random(5)
    rows = conversation_rows(rng)
    # ties of a turn are ordered by digest, so what a tie's damage does is the same for all of them
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], CONVERSATIONS)
    got = conversation_repair.repairs(conversation_repair.damaged(df), conversation_repair.F.col("present"))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert digests(got) == brute_repairs(rows)
    plain = conversation_repair.repairs(df)
    assert plain.count() == 401
    by = {}
    for r in sorted(conversation_repair.repaired(df).collect(), key=lambda r: r.position):
        by.setdefault(r.conv_id, []).append(r)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in own)) for own in by.values())
    texts = {c: sha("\n".join(f"{r.role}:{r.text}" for r in own)) for c, own in by.items()}
    assert all(r.repaired_sha256 == texts.get(r.conv_id, sha("")) for r in plain.collect())
    assert conversation_repair.repairs(df.limit(0)).count() == 0


def test_a_long_conversation_and_common_signatures(spark, monkeypatch):
    rows = [(1, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(3000)]
    rows += [(c, t, ("user", "assistant")[t % 2], "same.") for c in range(2, 60) for t in range(2)]
    rows += [(99, 0, "assistant", "a."), (99, 1, "user", "b.")]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], CONVERSATIONS)
    monkeypatch.setattr(conversation_repair, "COMMON", 2)
    got = {r.conv_id: (r.cost, r.audit) for r in conversation_repair.repairs(df).collect()}
    assert got[1] == (0, "K" * 3000) and got[2] == (0, "KK") and got[99] == (6, "IKKI") and len(got) == 60


def test_each_suffix_is_one_node(monkeypatch):
    made, own = [], conversation_repair.Node

    def counted(letter, after):
        made.append(letter)
        return own(letter, after)

    monkeypatch.setattr(conversation_repair, "Node", counted)
    signatures = ["ua", "uaua", "sua", "aua", "ua-", "U", "", "uA-", "Aua"]
    suffixes = conversation_repair.Suffixes()
    for s in sorted(signatures, key=lambda s: s[::-1]):
        suffixes.node(s[::-1])
    assert len(made) == len({s[i:] for s in signatures for i in range(len(s) + 1)})


def test_new_queries_are_registered():
    assert {"op11_conversation_repair", "op12_decontamination", "op13_periodic_runs"} <= set(queries.queries())
