"""Hard negatives, repeated lines and spelling variants against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickfold.llm import bloom, lines, negatives, spelling

# -- Bloom filters --------------------------------------------------------------------


def test_bloom_holds_what_was_added_and_little_else():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    one = bloom.Bloom(bloom.blocks_for(10_000, 16))
    one.add(h[:10_000])
    assert one.contains(h[:10_000]).all()
    assert one.contains(h[10_000:]).mean() < 0.01
    growing = bloom.GrowingBloom(16, first_keys=100)
    for part in np.array_split(h[:10_000], 37):
        growing.add(part)
    assert len(growing.parts) > 3 and growing.contains(h[:10_000]).all()
    assert growing.contains(h[10_000:]).mean() < 0.01


def test_segments_put_together_are_the_filter(spark, monkeypatch):
    monkeypatch.setattr(bloom, "SEGMENT_BLOCKS", 16)
    h = np.random.default_rng(2).integers(0, 2**64, 3000, dtype=np.uint64)
    blocks = bloom.blocks_for(3000, 16)
    whole = bloom.Bloom(blocks)
    whole.add(h)
    rows = spark.createDataFrame([(0, blocks, int(x)) for x in h.view(np.int64)], "shard int, blocks bigint, h bigint")
    built = bloom.build_segments(rows).cache()
    last = -(-blocks // 16)
    assert (bloom.loaded(built, 0, blocks, 0, last).words == whole.words).all()
    halves = [bloom.loaded(built, 0, blocks, 0, 2), bloom.loaded(built, 0, blocks, 2, last)]
    assert (halves[0].contains(h) ^ halves[1].contains(h)).all()


# -- lines ----------------------------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"


def naive_lines(rows, min_docs=3, least=20):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))

    split = [(i, (t or "").split("\n")) for i, t in rows]
    holders = defaultdict(list)
    for i, some in split:
        for k in {key(x) for x in some}:
            if len(k) >= least:
                holders[k].append(i)
    keep = {
        k: max((i for i in ids if i is not None), default=None)
        for k, ids in holders.items() if len(ids) >= min_docs
    }
    out = []
    for i, some in split:
        left = [x for x in some if keep.get(key(x), i) == i]
        out.append((i, len(some), len(some) - len(left), "\n".join(left)))
    return out


LONG = "a line that is long enough to count"
ODD = "Ünïcödé lines are counted ÉÈ"
TEXTS = [
    (1, f"{LONG}\nown line of the first document\nshort"),
    (2, f"  {LONG.upper()}\t\r\nshort\n{LONG}\n{LONG}"),
    (3, f"{LONG}\n{ODD}\nshort\n"),
    (4, f"{ODD}\n{ODD.lower()}"),
    (5, f"x\n{ODD}\n{LONG} twice"),
    (6, None), (7, ""), (8, "\n\n"), (9, f"{ODD}"), (9, f"{ODD}"),
    (None, f"{LONG} twice\n{LONG}"), (10, f"{LONG} twice"),
    (11, "word " * 60_000), (12, "word " * 60_000), (13, "word " * 60_000),
    (14, "éééééééééé" * 2), (15, "éééééééééé" * 2), (16, "éééééééééé" * 2), (17, "é" * 19), (18, "é" * 19), (19, "é" * 19),
]


@pytest.mark.parametrize("how", ["table", "join"])
def test_lines_equal_brute_force(spark, monkeypatch, how):
    if how == "join":
        monkeypatch.setattr(lines, "MAX_TABLE_BYTES", 0)
        monkeypatch.setattr(lines, "MAX_FILTER_BYTES", 0)
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string").repartition(4)
    docs = docs.withColumn("key", F.lit(1)).withColumn("h", F.lit(2)).withColumn("_place", F.lit(3))
    got = [tuple(r) for r in lines.drop_repeated_lines(docs).collect()]
    want = [(*r, hashlib.sha256(r[3].encode()).hexdigest()) for r in naive_lines(TEXTS)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_lines_of_many_documents(spark, monkeypatch):
    """Hashes sent in several parts, filters that grow, another number of documents."""
    monkeypatch.setattr(lines, "FLUSH", 50)
    rng = np.random.default_rng(3)
    rows = [
        (int(i), "\n".join(f"line number {n} of the common lines" for n in rng.zipf(1.3, 12) % 500))
        for i in rng.permutation(400)
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for min_docs in (2, 3, 5):
        got = lines.drop_repeated_lines(docs, min_docs).drop("kept_sha256").collect()
        assert sorted(map(tuple, got)) == sorted(naive_lines(rows, min_docs))


def test_no_lines(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lines.drop_repeated_lines(empty).collect() == []


# -- spelling -------------------------------------------------------------------------


def naive_words(rows, every=31, least=7, least_n=2):
    counts = Counter()
    for i, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= least_n}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def naive_variants(rows, **how):
    words = naive_words(rows, **how)
    forms, near = {}, {}
    for w, n in words.items():
        some = [(-m, v) for v, m in words.items() if abs(len(v) - len(w)) < 2 and one_edit(v, w)]
        near[w] = len(some)
        best = min(some, default=None)
        forms[w] = (best[1], -best[0]) if best and -best[0] >= 10 * n else (None, None)
    out = []
    for w, n in words.items():
        root = w
        while forms[root][0] is not None:
            root = forms[root][0]
        out.append((w, forms[w][0], root, n, near[w], forms[w][1]))
    return sorted(out)


def spelled():
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcdefgéüñÿ"), rng.integers(6, 12))) for _ in range(40)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = base[min(int(rng.zipf(1.4)) - 1, 39)]
            if rng.random() < 0.2:
                at = rng.integers(0, len(w))
                w = [w[:at] + w[at + 1 :], w[:at] + "z" + w[at:], w[:at] + "ö" + w[at + 1 :]][rng.integers(0, 3)]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words) + ", ÉTÉÉTÉÉ×÷ÿ aaaaaaaa aaaaaaa baaaaaaa"))
    long = "q" * 30_000
    return rows + [(None, "nothing nothing nothinng"), (7, None), (8, ""), (9, "?!"),
                   (900, f"{long} {long}x"), (901, f"{long} {long}x {long[1:]}y {long[1:]}y")]


@pytest.mark.parametrize("passes", ["one", "many"])
def test_spelling_equals_brute_force(spark, monkeypatch, passes):
    if passes == "many":
        monkeypatch.setattr(spelling, "FLUSH", 100)
        monkeypatch.setattr(spelling, "TILE", 5000)
    rows = spelled()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    docs = docs.withColumn("word", F.lit("x")).withColumn("n", F.lit(0)).withColumn("h", F.lit(0))
    if passes == "one":
        got = spelling.spelling_variants(docs)
    else:
        words = spelling.stored(spelling.count_words(docs).where("n >= 2"), "vocabulary")
        got = spelling.variants(words, spelling.near_words(words, pass_bytes=9000))
    got = sorted(tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == naive_variants(rows)
    assert any(r[1] is not None for r in got)


def test_forms_are_followed_to_the_last(spark):
    rows = [("abcdefg", 1000), ("abcdefh", 100), ("abcdeih", 10), ("abcjeih", 1), ("zzzzzzz", 5)]
    words = spelling.stored(spark.createDataFrame(rows, "word string, n bigint"), "vocabulary")
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in
           spelling.variants(words, spelling.near_words(words)).collect()}
    assert got["abcjeih"] == ("abcdeih", "abcdefg", 1)
    assert got["abcdefh"] == ("abcdefg", "abcdefg", 2) and got["zzzzzzz"] == (None, "zzzzzzz", 0)


def test_large_filters_are_asked_in_parts():
    passes = spelling.plan_passes({7: 20_000, 8: 100, 9: 9000}, limit=1 << 20)
    assert all(sum(p.size for p in some) <= 1 << 20 for some in passes) and len(passes) > 1
    assert sum(p.size for some in passes for p in some) == 29_100 * bloom.BLOCK_BYTES


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.spelling_variants(empty).collect() == []
    one = spark.createDataFrame([(1, "12 ab"), (2, None)], "doc_id bigint, text string")
    assert spelling.spelling_variants(one).collect() == []


# -- negatives ------------------------------------------------------------------------


def naive_negatives(rows, step=5, positives=5, negatives_=10, low=30, high=90):
    rows = [
        (i, label, [int(x) for x in v])
        for i, label, v in {(i, lab, None if v is None else tuple(v)) for i, lab, v in rows}
        if i is not None and label is not None and v is not None
        and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, label, v in rows:
        if i % step:
            continue
        others = [
            (-sum(a * b for a, b in zip(v, w)), j, lab) for j, lab, w in rows if j != i and len(w) == len(v)
        ]
        for minus, p, _ in sorted(o for o in others if o[2] == label)[:positives]:
            fit = sorted(
                o for o in others if o[2] != label and low * -minus <= 100 * -o[0] <= high * -minus
            )[:negatives_]
            out += [(i, p, r, o[1], -minus, -o[0]) for r, o in enumerate(fit, start=1)]
    return sorted(out)


def vectors_of(seed, n=400, dims=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dims))
    v = np.floor(256 * (centers[rng.integers(0, 8, n)] + 0.3 * rng.normal(size=(n, dims))))
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in v[i]]) for i in range(n)]
    # Copies under other ids, and ties.
    return rows + [(n + i, rows[0][1] if i % 2 else (rows[0][1] + 1) % 4, rows[0][2]) for i in range(90)]


SCHEMA = "id bigint, label int, v array<double>"


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives, "TREE_ROWS", 60)
    monkeypatch.setattr(negatives, "PIVOTS", 5)
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 40)
    odd = [
        (None, 1, [1.0] * 6), (1000, None, [1.0] * 6), (1005, 1, None), (1010, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
        (1015, 1, [float("nan")] * 6), (1020, 1, [float("inf")] * 6), (1025, 1, [0.0] * 6), (1030, 2, [0.0] * 6),
        (1035, 1, [3.0, 4.0]), (1040, 1, [3.0, 5.0]), (1045, 2, [1.0, 2.0]), (1050, 1, []), (1055, 1, []), (1060, 2, []),
        (1065, 1, [2.0**30] * 6), (1070, 1, [2.0**30 + 1] * 6), (1075, 2, [2.0**29 + 1] * 6),
    ]
    rows = vectors_of(seed) + odd
    table = spark.createDataFrame(rows + rows[:30], SCHEMA).repartition(3)
    table = table.withColumn("rid", F.lit(1)).withColumn("tree", F.lit("x")).withColumn("dims", F.lit(0))
    got = negatives.hard_negatives(table, F.col("id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == naive_negatives(rows)


def test_no_vectors(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("id") % 5 == 0).collect() == []
    alone = spark.createDataFrame([(5, 1, [1.0, 2.0])], SCHEMA)
    assert negatives.hard_negatives(alone, F.col("id") % 5 == 0).collect() == []


def test_bounds_hold_and_leaves_are_skipped():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(10, 8)) * 400
    v = np.floor(centers[rng.integers(0, 10, 3000)] + 5 * rng.normal(size=(3000, 8)))
    ids, labels = np.arange(3000), rng.integers(0, 3, 3000)
    tree = negatives.build_tree(ids, labels, v)
    assert sorted(tree["ids"].tolist()) == ids.tolist()
    q = v[::300]
    low, high = negatives.node_bounds(tree, q)
    for leaf, a, b in zip(tree["leaf"], tree["start"], tree["stop"]):
        s = tree["v"][a:b] @ q.T
        assert (s <= high[:, leaf] + 1e-6).all() and (s >= low[:, leaf] - 1e-6).all()
    anchor = {"v": q[0], "label": int(labels[0]), "id": 0}
    query = negatives._Query(tree, anchor, low[0], high[0], True)
    query.best(5, None, None, None)
    assert len(query.known) < len(tree["leaf"]) / 2


def searched(tables, anchors, k, same):
    """What a block of anchors (rid, id, label, v, tree, windows) finds in trees, by anchor and window."""
    import pyarrow as pa

    window = pa.struct([(n, pa.int32() if n == "at" else pa.int64()) for n in ("at", "floor", "ceiling", "least")])
    block = pa.table({
        "rid": pa.array([a[0] for a in anchors], pa.int64()), "id": pa.array([a[1] for a in anchors], pa.int64()),
        "label": pa.array([a[2] for a in anchors], pa.int64()),
        "v": pa.array([list(a[3]) for a in anchors], pa.list_(pa.float64())),
        "tree": pa.array([a[4] for a in anchors], pa.int32()),
        "windows": pa.array([
            [dict(at=i, floor=lo, ceiling=hi, least=least) for i, (lo, hi, least) in enumerate(a[5])] for a in anchors
        ], pa.list_(window)),
    })
    search = negatives._Search(negatives._block(block), k, same)
    trees = [negatives._Tree(i, negatives.pack_tree(negatives.build_tree(*t))) for i, t in enumerate(tables)]
    for own in (True, False):
        for tree in trees:
            search.visit(tree, own)
    found = defaultdict(list)
    for r in search.found().to_pylist():
        found[r["rid"], r["at"]].append((-r["score"], r["id"]))
    return found


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("kinds", [4, 150])  # labels: piece by piece, or looked at pair by pair
@pytest.mark.parametrize("scale", [1, 2**14, 2**20])  # exact in single and double precision, and in neither
def test_a_block_of_anchors_is_compared_at_once(monkeypatch, same, kinds, scale):
    for name, value in (("PIECE", 100), ("BLOCK", 16), ("PROBE", 5), ("LEAF", 8)):
        monkeypatch.setattr(negatives, name, value)
    alone = []
    monkeypatch.setattr(negatives, "_scores", lambda v, q, f=negatives._scores: alone.append(len(v)) or f(v, q))
    rng = np.random.default_rng(kinds)
    tables = []
    for number in range(3):
        v = np.floor(200 * rng.normal(size=(900, 6))) * scale
        v[500:] = v[rng.integers(0, 40, 400)]  # ties
        tables.append((rng.permutation(900) + 800 * number, rng.integers(0, kinds, 900), v))
    rows = [(int(i), int(lab), w) for t in tables for i, lab, w in zip(*t)]
    anchors = []
    for rid, at in enumerate(rng.integers(0, len(rows), 90)):
        i, label, v = rows[at]
        top = int(v @ v)
        windows = [(None, None, None), (0, top // 2, None), (-top, 0, -top // 4), (top, 0, None)][: 1 + rid % 4]
        anchors.append((rid, i, label, v, at // 900, windows))
    found = searched(tables, anchors, 7, same)
    for rid, i, label, v, _, windows in anchors:
        mine = [int(x) for x in v]
        scores = [(-sum(int(a) * b for a, b in zip(w, mine)), j) for j, lab, w in rows if j != i and (lab == label) == same]
        for at, (lo, hi, least) in enumerate(windows):
            low = max(x for x in (lo, least, -(2**62)) if x is not None)
            fit = sorted(s for s in scores if low <= -s[0] and (hi is None or -s[0] <= hi))
            assert found[rid, at] == fit[:7]
    # Scores that a double holds are not worked out anchor by anchor.
    assert bool(alone) == (scale == 2**20)


def test_far_trees_and_pieces_are_left_out(monkeypatch):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, 8)) * 400
    tables = []
    for number in range(4):
        at = rng.integers(3 * number, 3 * number + 3, 3000)
        v = np.floor(centers[at] + rng.normal(size=(3000, 8)))
        tables.append((np.arange(3000) + 3000 * number, rng.integers(0, 3, 3000), v))
    rows = [(i, lab, v) for t in tables for i, lab, v in zip(*t)]
    anchors = [(n, *rows[n], n // 3000, [(None, None, None)]) for n in range(0, 12_000, 100)]
    pairs, compare = [], negatives._Search._compare

    def counted(self, tree, some, a, b, *rest):
        pairs.append(len(some) * (b - a))
        compare(self, tree, some, a, b, *rest)

    monkeypatch.setattr(negatives._Search, "_compare", counted)
    found = searched(tables, anchors, 5, True)
    assert len(found) == 120 and all(len(f) == 5 for f in found.values())
    # At home all rows of the label, of the three other trees few.
    assert sum(pairs) < 120 * 1500


def test_equal_positives_share_a_window(spark):
    rng = np.random.default_rng(8)
    v = [[float(x) for x in np.floor(100 * w)] for w in rng.normal(size=(60, 5))]
    rows = [(i + 60 * n, i % 3, v[i]) for i in range(60) for n in range(7)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == naive_negatives(rows)


def test_lossless_is_what_decoding_says():
    import random

    import public_tokenizers

    from tickfold.llm import pieces

    seg, rng = pieces.Segmenter(public_tokenizers.path("piece_bpe_32k.model"), 4), random.Random(9)
    chars = "ab é日\U0001f600▁\0 \t\n<unk>ÿ"
    texts = ["", " ", "  a", "a  b ", "▁", "a▁b", "日本 語", "\0 a", "\0", "é\U0001f600 \U0001f600", "un <unk> 0x0A"]
    texts += ["".join(rng.choice(chars) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    for text, best in zip(texts, seg.segment_all(texts)):
        for _, raw, same in best:
            assert same == (seg.decode(np.frombuffer(raw, "<u4").tolist()) == text), repr(text)
