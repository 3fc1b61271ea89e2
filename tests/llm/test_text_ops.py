"""Operators on documents against brute force, and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratakv.llm import bpe, hilbert, langid, linededup, minhash, mixing, substring
from stratakv.llm.common import WORD_PATTERN, materialize, words_of
from stratakv.llm.prefix import sums_before
from stratakv.llm.queries import tokenizer_path

WORD = re.compile(WORD_PATTERN)


def rows(df):
    return [r.asDict() for r in df.collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- op1 ------------------------------------------------------------------------------------------


def shingle_set(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_brute(pairs):
    """{doc_id: (set size, component)} with every pair compared."""
    sets, u = [(d, shingle_set(t)) for d, t in pairs], Union()
    for i, (a, x) in enumerate(sets):
        u.find(a)
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                u.join(a, b)
    return {(d, len(s), u.find(d)) for d, s in sets}


def test_near_duplicates_match_brute_force(spark, sf):
    docs = documents(spark, sf)
    got = rows(minhash.near_duplicates(docs))
    want = near_brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_large_groups(spark):
    """A chain of edits: neighbours link, ends do not; members of one bucket that are not all similar."""
    base = [f"b{i}" for i in range(100)]
    texts = []
    for i in range(40):
        edited = list(base)
        for j in range(i):
            edited[(j * 5) % 100] = f"e{j}"
        texts.append((1000 - i, " ".join(edited)))
    texts += [(2000 + i, " ".join(base[:50] + [f"z{i}_{j}" for j in range(50)])) for i in range(60)]
    texts += [(5000 + i, " ".join(base)) for i in range(50)]
    got = rows(minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == near_brute(texts)


def test_near_duplicates_blocks_alone_find_all_links(spark, monkeypatch):
    """Tiny blocks, and first links withheld."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "_plausible", lambda pairs, reps: pairs.limit(0))
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(30):
        edited = list(base)
        for j in rng.choice(60, size=int(rng.integers(0, 4)), replace=False):
            edited[j] = f"x{i}_{j}"
        texts.append((int(rng.integers(0, 10**9)), " ".join(edited)))
    got = rows(minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == near_brute(texts)


def test_near_duplicates_on_odd_rows(odd, empty):
    got = rows(minhash.near_duplicates(odd))
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[2]["component_id"] == by[1]["component_id"] == 1
    assert by[7]["component_id"] == 6
    assert [by[d]["n_shingles"] for d in (3, 4, 5, -7, 8)] == [0, 0, 0, 1, 1]
    assert all(by[d]["kept"] for d in (3, 4, 5))
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({d for d in by if by[d]["kept"]})
    assert minhash.near_duplicates(empty).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, and copies without an id."""
    a, b, c = ("".join(f"{x}{i} " for i in range(40)) for x in "abc")
    data = [(1, a), (1, a), (1, a.upper()), (2, a), (1, b), (None, b), (None, c), (None, c), (None, c + "more"), (None, None), (7, "")]
    data += [(7, ""), (10, "one two")]
    kept = minhash.keep_one(spark.createDataFrame(data, "doc_id long, text string"))
    assert Counter((r["doc_id"], (r["text"] or "")[:1].lower()) for r in kept.collect()) == Counter({(1, "a"): 1, (1, "b"): 1, (None, "c"): 1, (None, ""): 1, (7, ""): 1, (10, "o"): 1})


def test_odd_sketch_estimates(spark):
    """Sketch distances follow the share of differing samples."""
    rng = np.random.default_rng(1)
    for share in (0.6, 0.75, 0.9):
        a = rng.integers(0, 1 << 32, size=(50, minhash.SAMPLES), dtype=np.uint32)
        b = np.where(rng.random(a.shape) < share, a, rng.integers(0, 1 << 32, size=a.shape, dtype=np.uint32)).astype(np.uint32)
        x = minhash.odd_sketches(a).view(np.uint64) ^ minhash.odd_sketches(b).view(np.uint64)
        bits = np.bitwise_count(x).sum(axis=1)
        estimate = 1 + minhash.SKETCH_BITS / (4 * minhash.SAMPLES) * np.log(1 - 2 * bits / minhash.SKETCH_BITS)
        assert abs(estimate.mean() - (a == b).mean()) < 0.02
        if share >= 0.75:
            assert (bits <= minhash.most_odd_bits()).all()


# -- op2 ------------------------------------------------------------------------------------------


def lines_brute(pairs, width=3):
    seen, out = set(), {}
    for d, text in sorted(pairs, key=lambda p: p[0]):
        lines = text.split("\n") if text is not None else []
        covered, new = set(), []
        for i in range(len(lines) - width + 1):
            w = tuple(lines[i : i + width])
            if w in seen:
                covered |= set(range(i, i + width))
            else:
                seen.add(w)
        out[d] = (len(lines), len(covered), None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in covered))
    return out


def test_line_dedup_matches_brute_force(spark, sf):
    docs = documents(spark, sf)
    got = {r["doc_id"]: (r["_n_lines"], r["_n_removed"], r["text"]) for r in rows(linededup.dedup_lines(docs))}
    assert got == lines_brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_line_dedup_inside_one_document(spark):
    texts = [(1, "a\nb\nc\na\nb\nc\na"), (2, "a\na\na\na\na"), (3, "a\nb"), (4, "q\nb\nc\na\nq"), (5, "")]
    got = {r["doc_id"]: (r["_n_lines"], r["_n_removed"], r["text"]) for r in rows(linededup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")))}
    assert got == lines_brute(texts)


def test_line_dedup_on_odd_rows(odd, empty):
    out = linededup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "_n_lines", "_n_removed"]
    got = rows(out)
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[9]["text"] == "l1\nl2\nl3\nl4"
    assert by[10]["text"] == "x\ny"
    assert (by[4]["text"], by[4]["_n_lines"]) == ("", 1)
    assert (by[3]["text"], by[3]["_n_lines"]) == (None, 0)
    assert all(r["key"] == "clash" for r in got)
    assert linededup.dedup_lines(empty).count() == 0


# -- op4 ------------------------------------------------------------------------------------------


def targets_brute(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * rest / w > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * rest / w for s in names}
        full |= over


def points(n):
    """Points of the schedule's slots, in whole numbers of any size."""
    return [i * mixing.GOLDEN % (1 << mixing.POINT_BITS) for i in range(n)]


def check_mix(docs, block, least=16):
    """Targets, and a plain replay of the schedule over the shuffled documents, word by word."""
    slots, got = mixing.mix(docs, block=block, least_slots=least)
    got, slots = rows(got), sorted(rows(slots), key=lambda r: r["slot"])
    sizes, streams = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r["source"]] += r["size"]
    targets = targets_brute(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    width = {s: max(1, min(block, int(targets[s] // least))) for s in names}
    blocks = {s: -(-sizes[s] // width[s]) for s in names}
    need = {s: int(targets[s] * blocks[s] / sizes[s] + 0.5) if sizes[s] else 0 for s in names}
    total, edges, upto = sum(need.values()), [], 0
    for s in names:
        upto += need[s]
        edges.append((upto << mixing.POINT_BITS) // max(total, 1))
    for i, r in enumerate(sorted(got, key=lambda r: r["start"])):
        streams[r["source"]] += [i] * r["size"]
        r["no"] = i
    taken, drawn, first, touched = Counter(), Counter(), {}, Counter()
    for slot, u in enumerate(points(total)):
        s = next(x for x, edge in zip(names, edges, strict=True) if u < edge)
        r, b = divmod(drawn[s], blocks[s])
        assert (slots[slot]["source"], slots[slot]["slot"], slots[slot]["rank"], slots[slot]["block_no"]) == (s, slot, drawn[s], b)
        drawn[s] += 1
        part = Counter(streams[s][b * width[s] : (b + 1) * width[s]]) if r < 3 else {}
        assert slots[slot]["words"] == sum(part.values())
        for no, n in part.items():
            taken[no] += n
            touched[no] += 1
            first.setdefault(no, slot)
    assert len(slots) == total
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source"]], abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert (r["taken"], r["first_slot"], r["n_slots"]) == (taken[r["no"]], first.get(r["no"]), touched[r["no"]])
        assert sum(c["words"] for c in r["copies"]) == r["taken"]
    for s in sizes:
        assert abs(drawn[s] - need[s]) <= mixing.bound(total)
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - targets[s]) <= 5 * width[s]
    return got


def test_mix_follows_the_schedule(spark, sf):
    docs = documents(spark, sf)
    got = check_mix(docs, 64)
    assert {r["doc_id"]: r["size"] for r in got} == {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.collect()}


@pytest.fixture(scope="module")
def mixed(spark, sf):
    slots, got = mixing.mix(documents(spark, sf))
    return rows(slots.orderBy("slot")), rows(got)


def test_mix_comes_near_its_targets(mixed):
    taken, target = Counter(), {}
    for r in mixed[1]:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= max(5, 0.005 * t) for s, t in target.items())


def test_mix_spreads_sources_evenly(mixed):
    """Any stretch of the schedule holds each source near its share."""
    seq = [r["source"] for r in mixed[0]]
    total = Counter(seq)
    for at in range(0, len(seq) - 500, 500):
        part = Counter(seq[at : at + 500])
        for s, n in total.items():
            assert abs(part[s] - 500 * n / len(seq)) < 12


def test_the_step_decides_what_is_taken(spark, sf, mixed, monkeypatch):
    """Reruns agree; another step gives another order; one that is no low-discrepancy step is refused."""
    docs = documents(spark, sf)
    first = lambda got: {r["doc_id"]: (r["taken"], r["first_slot"]) for r in got}
    assert first(mixed[1]) == first(rows(mixing.mix(docs)[1]))
    step = mixing.point
    monkeypatch.setattr(mixing, "point", lambda slot: step(slot, int(2**0.5 * 2**47) | 1))
    assert first(mixed[1]) != first(rows(mixing.mix(docs)[1]))
    monkeypatch.setattr(mixing, "point", lambda slot: step(slot, (1 << 47) + 1))
    with pytest.raises(ArithmeticError):
        mixing.mix(docs)


def test_points_of_far_slots(spark):
    far = [0, 1, 2**15, 2**30 - 1, 2**33 + 5, 2**45 - 1]
    df = spark.createDataFrame([(i,) for i in far], "i long").select("i", mixing.point(F.col("i")).alias("u"))
    assert {r["i"]: r["u"] for r in df.collect()} == {i: i * mixing.GOLDEN % 2**48 for i in far}


def test_sums_before(spark):
    rng = random.Random(3)
    data = [(g, p, rng.randrange(9)) for g in (1, 2) for p in rng.sample(range(400), 150)]
    got = rows(sums_before(spark.createDataFrame(data, "g int, p long, x int"), ["g"], "p", "x", "before", width=4))
    assert Counter((r["g"], r["p"], r["x"], r["before"]) for r in got) == Counter((g, p, x, sum(y for h, q, y in data if h == g and q < p)) for g, p, x in data)


def test_mix_on_odd_rows(odd, empty, spark, tmp_path):
    got = check_mix(odd, 64)
    assert len(got) == odd.count()
    mixed = mixing.mixed_rows(odd, block=64, least_slots=16)
    assert mixed.columns == odd.columns
    mixed = mixed.collect()
    assert sum(len(words_of(r["text"])) for r in mixed) == sum(r["taken"] for r in got)
    order = [c["slot"] for r in got for c in r["copies"]]
    assert len(mixed) == len(order)
    first = {r["doc_id"]: r["first_slot"] for r in got if r["doc_id"] not in (2, None) and r["taken"]}
    seen = list(dict.fromkeys(r["doc_id"] for r in mixed if r["doc_id"] in first))
    assert [first[d] for d in seen] == sorted(first.values())
    assert mixing.mix(empty)[1].count() == 0
    assert mixing.mixed_rows(empty).count() == 0
    assert [r["taken"] for r in rows(mixing.mix(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string"))[1])] == [0]


# -- op5 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(n, bits):
    from itertools import product

    cells = sorted(product(range(1 << bits), repeat=n), key=lambda c: hilbert.curve_index(list(c), bits))
    assert sorted(hilbert.curve_index(list(c), bits) for c in cells) == list(range(1 << n * bits))
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(cells, cells[1:], strict=False))


def check_shards(docs, shards, dims=("source", "lang", "n_chars"), bits=4):
    """Quanta by plain ranks, the curve's index, and runs of the ordered rows."""
    import zlib

    got = rows(hilbert.shard(docs, list(dims), shards, bits))
    data = [r.asDict() for r in docs.collect()]
    n, side = len(data), 1 << bits
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    quanta = []
    for c in dims:
        values = sorted((r[c] for r in data), key=order)
        first = {}
        for i, v in enumerate(values):
            first.setdefault(v, i * side // n)
        quanta.append([first[r[c]] if r[c] is not None else 0 for r in data])
    text = [(r["text"] or "").encode() for r in data]
    cells = [hilbert.curve_index([q[i] for q in quanta], bits) for i in range(n)]
    names = [hashlib.md5(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()).hexdigest() for r in data]
    ranked = sorted((cells[i], names[i], len(text[i]) + 1, zlib.crc32(text[i]), i) for i in range(n))
    want = Counter()
    for rank, (cell, _, size, crc, i) in enumerate(ranked):
        s = rank * shards // n
        want[data[i]["doc_id"], size, crc, cell, s, rank - -(-s * n // shards)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["curve"], r["shard"], r["slot"]) for r in got) == want
    counts = [sum(r["shard"] == s for r in got) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    return got


def test_shards(spark, sf, monkeypatch):
    docs = documents(spark, sf)
    check_shards(docs, 16)
    monkeypatch.setattr(hilbert, "SUB_ROWS", 7)
    check_shards(docs.withColumn("source", F.lit("one")).withColumn("lang", F.lit("one")).withColumn("n_chars", F.lit(5)), 16)


def test_shards_on_odd_rows(odd, empty):
    check_shards(odd, 100)
    assert hilbert.shard(empty, ["source", "lang", "n_chars"]).count() == 0


def test_odd_dimensions(spark):
    """NaN is null; nested columns order as text; very long values are cuts like others."""
    data = [(i, "t", float("nan") if i % 3 == 0 else float(i), [i % 4], "x" * (i * 100)) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string, a double, b array<int>, c string")
    got = rows(hilbert.shard(df, ["a", "b", "c"], 4, 2))
    assert sorted(Counter(r["shard"] for r in got).values()) == [10] * 4
    assert {r["doc_id"]: r["q0"] for r in got} == {i: 0 if i % 3 == 0 else (14 + [j for j in range(40) if j % 3].index(i)) * 4 // 40 for i in range(40)}


def test_files_are_pruned_on_every_dimension(spark, tmp_path):
    """Files whose min-max range meets a predicate, of 64: on each of three dimensions, and on all of them."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(2)
    sources = [f"s{i:02}" for i in (rng.zipf(1.5, size=6000) % 20)]
    data = [(i, f"text {i}", ["de", "en", "es", "fr"][i % 4], sources[i], int(x)) for i, x in enumerate(rng.lognormal(6, 1.5, size=6000))]
    data += data[:3]
    dims = ["source", "lang", "n_chars"]
    hilbert.write(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path / "out"), dims, shards=16, file_rows=100)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in out.collect()) == Counter(data)
    spans = []
    for f in (tmp_path / "out").rglob("*.parquet"):
        t = pq.read_table(f).select(dims).to_pydict()
        spans.append({c: (min(t[c]), max(t[c])) for c in dims})
    assert len(spans) == 64
    meets = lambda f, c, lo, hi: f[c][0] <= hi and lo <= f[c][1]
    shares = {"source": [], "lang": [], "n_chars": [], "all": []}
    for _, _, lang, source, n in rng.permutation(np.array(data, dtype=object))[:60]:
        tests = [("source", source, source), ("lang", lang, lang), ("n_chars", n * 0.9, n * 1.1)]
        each = [[meets(f, *t) for f in spans] for t in tests]
        for c, e in zip(dims, each, strict=True):
            shares[c].append(np.mean(e))
        shares["all"].append(np.mean(np.all(each, axis=0)))
    assert {c: np.mean(v) < limit for (c, v), limit in zip(shares.items(), (0.65, 0.65, 0.5, 0.25), strict=True)} == dict.fromkeys(shares, True), {c: np.mean(v) for c, v in shares.items()}


# -- op7 ------------------------------------------------------------------------------------------


def check_bpe(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    texts = Counter()
    for r in docs.collect():
        e = library.encode(r["text"] or "", add_special_tokens=False)
        decoded = library.decode(e.ids, skip_special_tokens=False)
        texts[r["doc_id"], len(e.ids), sha(" ".join(map(str, e.ids))), sha(decoded)] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(bpe.digest(bpe.encode_decode(docs, tokenizer_path()))))
    assert got == texts


def test_bpe_matches_the_library(spark, sf, odd, empty):
    check_bpe(documents(spark, sf))
    check_bpe(odd)
    check_bpe(empty)


TRICKY = ["Hello  World's I'LL don't <|endoftext|>abc<|startoftext|> x<|endoftext|", "İstanbul ΣΑΣ naïve e\u0301 ﬁ 北京 a\u00a0b 😀😀 ١٢٣ ½ x²", "a\x85b\u2028c", "'s''t 'Re 're's", "µ ŉ ĸ ß ǅ Į į", "日本語</w> <|", "\u0301a \u0301", "x" * 400, "\x00\x01\x1c a\x1cb", "ãģĵ Ã©", "the thethe theth"]


def test_bpe_on_tricky_texts(spark):
    check_bpe(spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string"))


def test_bpe_cache_may_overflow(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 10)
    coder = bpe.TrieBpe(tokenizer_path())
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    for _ in range(3):
        for text in TRICKY:
            ids, cuts = coder.encode_batch([text, None, text])
            want = library.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == want + want
            assert cuts.tolist() == [0, len(want), len(want), 2 * len(want)]


# -- op9 ------------------------------------------------------------------------------------------


def test_language_id_on_held_out_rows(spark, sf):
    docs = documents(spark, sf)
    got = {r["doc_id"]: r for r in rows(langid.identify(docs))}
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [d for d, r in got.items() if r["held_out"]]
    assert len(held) > 20
    assert sum(got[d]["lang_pred"] == lang[d] for d in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_rows_do_not_teach(spark, sf):
    docs = documents(spark, sf)
    one = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows(langid.identify(docs))}
    lied = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert one == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows(langid.identify(lied))}


def test_language_id_on_odd_rows(odd, empty, spark):
    got = rows(langid.identify(odd))
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 for d in (3, 4, 5, 8))
    assert all(r["lang_pred"] in ("en", "de", "fr", "und") for r in got)
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns
    assert not {3, 4, 5, 8} & {r["doc_id"] for r in kept.collect()}
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in rows(langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}
    assert {r["lang_pred"] for r in rows(langid.identify(odd.withColumn("lang", F.lit("en"))))} == {"en", "und"}


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 12, 60):
        c = langid.codewords(n).astype(int)
        assert len({tuple(r) for r in c}) == n
        distance = ((c[:, None] != c[None]).sum(axis=2) + np.eye(n, dtype=int) * 999).min()
        assert distance >= (3 if n > 5 else 1)


def test_all_languages_are_learned(spark, monkeypatch):
    """300 languages, each of words of its own; also where the sample has but one row for each."""
    rng = random.Random(5)
    vocabulary = {f"l{i:03}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(5)] for i in range(300)}
    data = [(4 * i + j, " ".join(rng.choices(v, k=30)), lang) for i, (lang, v) in enumerate(vocabulary.items()) for j in range(4)]
    df = spark.createDataFrame(data, "id long, text string, lang string")
    texts = pa.array([t for _, t, _ in data])
    for most in (langid.SAMPLE_ROWS, 100):
        monkeypatch.setattr(langid, "SAMPLE_ROWS", most)
        model = langid.train(df)
        assert model.langs == sorted(vocabulary)
        found, _, _ = langid.judge(texts, model)
        assert sum(a == lang for a, (_, _, lang) in zip(found, data, strict=True)) >= 0.97 * len(data)


def test_no_language_is_lost_to_repeated_or_null_ids(spark):
    """The ids are no help in choosing the sample: thousands of rows with one id, or none, or one text."""
    rng = random.Random(8)
    vocabulary = {lang: ["".join(rng.choices(letters, k=6)) for _ in range(40)] for lang, letters in (("en", "abcdef"), ("fr", "ghijkl"), ("de", "mnopqr"), ("es", "stuvwx"))}
    data = [(i, " ".join(rng.choices(vocabulary[lang], k=20)), lang) for lang in ("en", "fr") for i in range(200)]
    data += [(None if i % 2 else 7, " ".join(rng.choices(vocabulary["de"], k=20)), "de") for i in range(2000)]
    data += [(9, " ".join(vocabulary["es"][:5]), "es")] * 1500 + [(9, " ".join(rng.choices(vocabulary["es"], k=20)), "es") for _ in range(10)]
    df = spark.createDataFrame(data, "id long, text string, lang string")
    chosen = Counter(r["lang"] for r in langid.sample(df, 100).collect())
    assert all(50 <= chosen[lang] <= 100 for lang in ("en", "fr", "de"))
    assert 10 <= chosen["es"] <= 11
    found, _, _ = langid.judge(pa.array([t for _, t, _ in data]), langid.train(df))
    assert all(a == lang for a, (_, _, lang) in zip(found, data, strict=True))


def test_language_scores_recomputed_one_by_one(spark, sf):
    """Features by a dictionary of n-grams, losses bit by bit, the codeword of least loss."""
    texts = [r["text"] for r in documents(spark, sf).limit(25).collect()] + ["Ünï  cödé 123 ABC", "z"]
    model = langid.train(documents(spark, sf).withColumnRenamed("doc_id", "id"))
    names, scores, _ = langid.judge(pa.array(texts), model)
    odd = [int(x) for x in langid.randoms(77, max(langid.ORDERS))]
    mask = (1 << 64) - 1

    def slot(gram):
        h = (len(gram) + sum((b + 1) * odd[i] for i, b in enumerate(gram))) & mask
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
        return (h ^ (h >> 31)) >> 52

    for text, name, score in zip(texts, names, scores, strict=True):
        data = re.sub(rb" +", b" ", bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in lower(text).encode()))
        grams = Counter(slot(data[i : i + k]) for k in langid.ORDERS for i in range(len(data) - k + 1))
        total = sum(grams.values())
        margins = model.bias + sum((n / total) ** 0.5 * model.weights[s] for s, n in grams.items())
        losses = [sum(np.log1p(np.exp(-c * m)) for c, m in zip(code.tolist(), margins, strict=True)) for code in model.codes]
        assert name == model.langs[int(np.argmin(losses))]
        assert score == pytest.approx(1 / sum(np.exp(min(losses) - x) for x in losses), abs=1e-4)


def test_codewords_of_many_languages():
    for n in (257, 3000):
        c = langid.codewords(n).astype(np.float32)
        gram = c @ c.T
        np.fill_diagonal(gram, -c.shape[1])
        assert (c.shape[1] - gram.max()) / 2 >= c.shape[1] // 8


# -- op10 -----------------------------------------------------------------------------------------


def spans_brute(pairs, k=50):
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in pairs]
    for d, w in split:
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = Counter()
    for d, w in split:
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i : i + k])] < d:
                gone |= set(range(i, i + k))
        out[d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    return out


def span_rows(docs):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substring.report(substring.dedup(docs))))


def test_substring_dedup_matches_brute_force(spark, sf):
    docs = documents(spark, sf)
    assert span_rows(docs) == spans_brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_forged_names_are_caught(spark, sf):
    """Names of 20 bits collide; verification finds it, and the next attempt gives the right result."""
    docs = documents(spark, sf)
    spans = materialize(substring.repeated_spans(docs, name_bits=20), "forged")
    assert not substring.unproven(spans, substring.remove_spans(docs, spans)).isEmpty()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substring.report(substring.dedup(docs, name_bits=20))))
    assert got == spans_brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_substring_sources_hold_the_words(spark, sf):
    docs = documents(spark, sf)
    texts = {r["doc_id"]: words_of(r["text"]) for r in docs.collect()}
    spans = rows(substring.repeated_spans(docs))
    assert spans
    for r in spans:
        assert r["source_doc"] < r["doc"]
        a, b = r["start"], r["source_start"]
        assert texts[r["doc"]][a : a + r["n_words"]] == texts[r["source_doc"]][b : b + r["n_words"]]


def test_nonbranching_paths_are_maximal(spark):
    """A passage in three texts is one span of each later one; where one text leaves it the graph branches."""
    passage = [f"p{i}" for i in range(700)]
    texts = [(1, passage), (2, ["u"] * 3 + passage + ["v"]), (3, passage[:400] + [f"x{i}" for i in range(90)])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in texts], "doc_id long, text string")
    spans = sorted((r["doc"], r["start"], r["n_words"], r["source_doc"], r["source_start"]) for r in rows(substring.repeated_spans(df)))
    assert spans == [(2, 3, 700, 1, 0), (3, 0, 400, 1, 0)]


def test_paths_of_units(spark):
    """compact() against a walk: units a..f in texts; d follows c always, but b's successors differ."""
    texts = {1: "abcdef", 2: "abcdef", 3: "xbcde", 4: "abq", 5: "xq"}
    # c, d, e follow one another in the source as well.
    data = [(0, 2, ord(c), 0, doc, 2 * i, 1) for doc, t in texts.items() for i, c in enumerate(t)]
    df = spark.createDataFrame(data, "layer int, n int, c1 long, c2 int, doc long, place long, source long")
    df = df.withColumn("source", F.min("doc").over(Window.partitionBy("c1")))
    got = {chr(r["c1"]): (r["length"], r["source"], r["source_place"]) for r in rows(substring.compact(df))}
    assert got == {"a": (2, 1, 0), "b": (2, 1, 2), "c": (6, 1, 4), "f": (2, 1, 10), "x": (2, 3, 0), "q": (2, 4, 4)}


def test_substring_dedup_of_shifted_and_branching_passages(spark):
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(200)]
    texts = []
    for d in rng.permutation(40).tolist():
        a = int(rng.integers(0, 150))
        b = int(rng.integers(a, 201))
        texts.append((d, " ".join([f"u{d}_{j}" for j in range(int(rng.integers(0, 30)))] + passage[a:b] + ["fork", f"v{d}"] * int(rng.integers(0, 3)) + passage[:60])))
    texts += [(100, " ".join(["a"] * 300)), (101, " ".join(["a"] * 120)), (102, " ".join(["a", "b"] * 70)), (103, " ".join(["b", "a"] * 70))]
    assert span_rows(spark.createDataFrame(texts, "doc_id long, text string")) == spans_brute(texts)


def test_substring_dedup_on_odd_rows(odd, odd_rows, empty):
    assert span_rows(odd) == spans_brute([(r[0], r[1]) for r in odd_rows])
    assert span_rows(empty) == Counter()
