"""Each operator on the rows that operators trip over, against plain versions of itself, and on an empty table."""

import collections
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skillgrid.llm import decontaminate, exact, html_cut, langid, mixing, pii, simhash, substrings, token_counts, token_store
from skillgrid.llm.queries import vocabulary
from skillgrid.session import shared_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


# ---- token store and counts --------------------------------------------------------------------


def test_store_round_trip(spark, docs, tokenizer):
    path = shared_path(spark, "store")
    token_store.write_store(docs, path, vocabulary())
    got = token_store.read_store(spark, path, with_ids=True).orderBy("start").collect()
    want = sorted((i, tokenizer.encode(t, add_special_tokens=False).ids + [1]) for i, t in texts(docs))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    at = 0
    for r, (_, ids) in zip(got, want):
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids), zlib.crc32(raw), raw)
        at += len(ids)


def test_store_of_nothing(spark, none):
    path = shared_path(spark, "store")
    token_store.write_store(none, path, vocabulary())
    assert token_store.read_store(spark, path).count() == 0


@pytest.mark.parametrize("counts", [[5], [1, 1], [0, 3, 0], [1, 1, 2, 3, 5, 8, 13, 21, 34, 55], [2**i for i in range(40)]])
def test_codes_are_prefix_free_and_short(counts):
    n = token_store.code_lengths(np.array(counts), 8)
    used = [c > 0 for c in counts]
    assert [x > 0 for x in n] == used and n.max() <= 8 and sum(2.0 ** -float(x) for x, u in zip(n, used) if u) <= 1


def test_codes_are_optimal_when_the_limit_does_not_bind():
    import heapq

    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, 60)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((counts * token_store.code_lengths(counts, 25)).sum()) == cost


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000])
def test_bits_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.05, n), 300).astype(np.uint32)
    lengths = token_store.code_lengths(np.bincount(ids, minlength=301))
    codes, width = token_store.canonical(lengths)
    bits, lanes = token_store.pack(ids, codes, lengths, width)
    assert (token_store.unpack(bits, lanes, n, token_store.decode_table(lengths)) == ids).all()


def test_counts(spark, docs, none, tokenizer):
    got = sorted(token_counts.count_tokens(docs, vocabulary()).collect())
    assert got == sorted((i, len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in texts(docs))
    assert sorted(token_counts.count_tokens(docs, vocabulary(), frequent=[]).collect()) == got  # the table decides nothing
    assert token_counts.count_tokens(none, vocabulary()).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_of_other_files(spark, docs, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    small = docs.where("length(text) < 1000")
    if name.endswith(".model"):
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    else:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(small, path).collect()) == sorted((i, count(t)) for i, t in texts(small))


# ---- substring dedup ---------------------------------------------------------------------------


def removed(rows):
    first = {}
    words = [(i, WORD.findall(t)) for i, t in rows]
    for i, w in words:
        for a in range(len(w) - 12):
            k = tuple(w[a : a + 13])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - 12):
            if first[tuple(w[a : a + 13])] < i:
                gone[a : a + 13] = [True] * 13
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def test_substrings(spark, docs, none):
    assert sorted(tuple(r) for r in substrings.remove_repeats(docs).collect()) == removed(texts(docs))
    assert substrings.remove_repeats(none).count() == 0


def test_substrings_at_random(spark):
    """Small vocabularies, shared passages that branch, repeats within a document, exact copies."""
    rng = np.random.default_rng(3)
    passages = [[f"p{k}_{j}" for j in range(40)] for k in range(4)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.integers(1, 5)):
            if rng.random() < 0.5:
                p = passages[rng.integers(4)]
                a = rng.integers(0, 27)
                w += p[a : a + rng.integers(5, 40)]
            else:
                w += [f"v{x}" for x in rng.integers(0, 3, rng.integers(1, 30))]
        rows.append((int(rng.permutation(1000)[0]) * 1000 + i, " ".join(w)))
    rows += [(10**7 + k, rows[k][1]) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in substrings.remove_repeats(df, slice_bytes=2000).collect()) == removed(rows)


# ---- SimHash -----------------------------------------------------------------------------------


def test_fingerprints_and_components(spark, docs, none):
    import xxhash

    rows = texts(docs)

    def plain(t):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        s = [" ".join(w[a : a + 3]) for a in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [plain(t) for _, t in rows]
    label = {k: k for k in range(len(rows))}
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (f[a] ^ f[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    want = sorted((i, format(f[k], "016x"), rows[label[k]][0]) for k, (i, _) in enumerate(rows))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hexadecimal("fp"), "component_id")
    assert sorted(tuple(r) for r in got.collect()) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("bits", [0, 3, 5, 7])
def test_no_link_is_lost(spark, bits):
    """Clusters around a few centres and many single ones, against all pairs; also with lists cut into blocks."""
    rng = np.random.default_rng(bits)
    centres = rng.integers(-(2**63), 2**63 - 1, 6)
    fps = [int(c) for c in rng.integers(-(2**63), 2**63 - 1, 200)]
    for c in centres:
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            fps.append(x - (1 << 64) if x >= 1 << 63 else x)
    fps = sorted({((x + 2**63) % 2**64) - 2**63 for x in fps})
    f = np.array(fps, np.int64).view(np.uint64)
    label = np.arange(len(f))
    while True:
        old = label.copy()
        for a in range(len(f)):
            near = np.bitwise_count(f ^ f[a]) <= bits
            label[near] = label[near].min()
        if (old == label).all():
            break
    classes = spark.createDataFrame([(x, [x]) for x in fps], "node long, fps array<long>")
    from skillgrid.operators.graph import connected_components

    for most in (4096, 20):
        edges = simhash.links(classes, bits, most=most)
        found = {r.node: r.component for r in connected_components(edges).collect()} if edges.count() else {}
        groups = collections.defaultdict(set)
        for k, x in enumerate(fps):
            groups[found.get(x, x)].add(k)
        want = collections.defaultdict(set)
        for k in range(len(fps)):
            want[label[k]].add(k)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_keep_first(spark, docs):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 0 in ids and 1 not in ids  # 1 differs in white space alone


# ---- decontamination ---------------------------------------------------------------------------

ITEMS = [(1, "sat on the MAT, and looked at the moon for a while"), (2, "İ"), (3, "one"), (4, ""), (5, None), (None, "w5 w6 w7"), (6, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_contamination(spark, docs, none, most):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    windows = collections.defaultdict(set)
    for i, t in ITEMS:
        w = split.findall(low(t or ""))
        for a in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[a : a + 10])].add("null" if i is None else str(i))
    want = []
    for i, t in texts(docs):
        w = split.findall(low(t))
        hit, items = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    items |= windows[tuple(w[a : a + n])]
                    hit |= set(range(a, a + n))
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    tests = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.report(decontaminate.contamination(docs, tests, most_bytes=most))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert decontaminate.contamination(none, tests).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(decontaminate.contamination(docs, tests.limit(0))).collect())


def test_removal(spark, docs):
    tests = spark.createDataFrame([(1, "sat on the mat and looked at the moon for")], "item_id long, text string")
    left = decontaminate.decontaminate(docs, tests)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5, 6, 7, 7, 8, 9]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, tests, remove="spans").collect()}
    assert cut[0] == "The cat  a while tonight" and cut[8] == "one" and cut[2] is None


# ---- exact dedup -------------------------------------------------------------------------------


@pytest.mark.parametrize("every", [True, False])
def test_exact(spark, docs, none, every):
    rows = [(i, t, re.sub(r"[\x20\x09-\x0D]", "", t)) for i, t in texts(docs)]
    want = []
    for i, t, n in rows:
        same = [(-len(u), j) for j, u, m in rows if m == n]
        want.append((i, min(same)[1], len(same), i == min(same)[1], hashlib.sha256(n.encode()).hexdigest()))
    got = [tuple(r) for r in exact.exact_groups(docs, digest_all=every).collect()]
    cut = 5 if every else 4
    assert sorted(r[:cut] for r in got) == sorted(r[:cut] for r in want)
    assert exact.exact_groups(none, digest_all=every).count() == 0


# ---- mixing ------------------------------------------------------------------------------------


def test_mixing(spark, docs, none):
    sized = mixing.sizes(docs)
    plan = mixing.plan_mix(sized)
    rows = mixing.taken(sized, plan).collect()
    assert len(rows) == docs.count() and all(0 <= r.copies <= 2 for r in rows)
    total = sum(r["size"] for r in rows)
    targets = {r.source: r.target for r in plan.collect()}
    assert sum(targets.values()) == pytest.approx(1.5 * total) and None in targets
    assert all(r.target <= 2 * r.source_size + 1e-9 for r in plan.collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    count = collections.Counter(r.doc_id for r in mixed.collect())
    want = collections.Counter()
    for r in rows:
        want[r.doc_id] += r.copies
    assert +count == +want
    assert mixing.mix(none).count() == 0


def test_one_draw_for_each_document(spark):
    """A copy's probability is the fraction, whatever else the source holds; what is taken is within five standard deviations of the target."""
    n = 20_000
    sized = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"), (10 + F.col("id") * 7 % 90).alias("size"))
    rates = spark.createDataFrame([("s0", 1.0, 1.0, 0.4), ("s1", 1.0, 1.0, 1.4), ("s2", 1.0, 1.0, 2.0), ("s3", 1.0, 1.0, 0.0)], "source string, source_size double, target double, rate double")
    rows = mixing.taken(sized, rates).join(sized.select("doc_id", "source"), "doc_id")
    seen = {r.source: r for r in rows.groupBy("source").agg(F.avg("copies").alias("copies"), F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.sum(F.col("size") * F.col("size")).alias("squares")).collect()}
    for source, rate in (("s0", 0.4), ("s1", 1.4), ("s2", 2.0), ("s3", 0.0)):
        f = rate % 1
        assert abs(seen[source].copies - rate) <= 5 * math.sqrt(f * (1 - f) / (n / 4))
        assert abs(seen[source].taken - rate * seen[source]["size"]) <= 5 * math.sqrt(f * (1 - f) * seen[source].squares)
    few = mixing.taken(sized.where("doc_id % 1000 < 3"), rates)
    both = few.select("doc_id", F.col("copies").alias("alone")).join(rows, "doc_id")
    assert both.count() == 60 and both.where("alone <> copies").count() == 0
    other = mixing.taken(sized, rates, seed=1).select("doc_id", F.col("copies").alias("other")).join(rows, "doc_id").where("source in ('s0', 's1')")
    assert 0.4 < other.where("other <> copies").count() / other.count() < 0.56  # independent draws differ in 2 f (1 - f) = 0.48


def test_water_filling(spark):
    rows = [("a", 100), ("b", 1000), ("c", 1000), ("d", 10)]
    sized = spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate(rows)], "doc_id long, source string, size long")
    got = {r.source: r.target for r in mixing.source_rates(sized).collect()}
    left, weight, targets = 1.5 * 2110, dict(zip("abcd", (3, 1, 2, 3))), {}
    while True:  # give out by weight, cap, and begin again with the others
        free = [s for s in weight if s not in targets]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * dict(rows)[s]]
        if not over:
            targets |= share
            break
        for s in over:
            targets[s] = 2.0 * dict(rows)[s]
            left -= targets[s]
    assert got == pytest.approx(targets)


# ---- pages -------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><a href=/>Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p>First&nbsp;para &eacute;t&#233; with <b>bold, <i>more</i>
 words.<p>Be.<div class="ad">Buy now!</div><aside>See also</aside><p>Last one, that ends the text here.</article>
<form><p>Name <input></p></form><section class="comments"><p>Nice article, I liked it very much indeed.</p></section><footer>&copy; X</footer>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<nav>only</nav>"), (None, "u", "plain & simple text, without any markup at all. It goes on for a while, and ends.")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_cut.extract(pages).collect()}
    assert got[1] == "A & B First para été with bold, more words. Be. Last one, that ends the text here."
    assert got[2] == got[3] == got[4] == "" and got[None].startswith("plain & simple")
    assert html_cut.extract(pages.limit(0)).count() == 0


def test_cut_is_minimal():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        gain = rng.normal(0, 2, n)
        edges = [(a, b, float(rng.random() * 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda x: sum(abs(g) for g, k in zip(gain, x) if (g > 0) != bool(k)) + sum(w for a, b, w in edges if x[a] != x[b])
        best = min(cost([m >> k & 1 for k in range(n)]) for m in range(1 << n))
        assert cost(html_cut.minimum_cut(gain, edges)) == pytest.approx(best)


# ---- personal data -----------------------------------------------------------------------------


def test_base_spans():
    pattern = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    cases = ["a@b.c@d.e.f _x@y.z a@b.com_x@d.e @b.c a@b", "1.2.3.4.5.6 256.1.1.1 001.2.3.4 1.2.3", "4111 1111 1111 1111-4111-1111-1111-1112 4111111111111111", "+1 (555) 555-0199. +12 +1 2345678901234567 + 1", "é" * 5 + " ü@a.b.c 9.9.9.9", "1" * 3000 + "." + "2" * 3000]
    rng = np.random.default_rng(2)
    cases += ["".join(rng.choice(list("a1.@+- 4(2é")) for _ in range(80)) for _ in range(300)]
    for text in cases:
        want = []
        for k, (name, p) in enumerate(pattern.items()):
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m[0])
                if name == "ip":
                    fine = all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))
                else:
                    fine = name == "email" or (14 <= len(digits) <= 19 and pii.luhn(digits) if name == "card" else 10 <= len(digits) <= 15)
                want += [(m.start(), k, m.end())] * fine
        assert pii.base_spans(text)[0] == sorted(want)


def test_personal_data(spark, docs, none):
    got = {r.doc_id: r for r in pii.report(pii.label(pii.find(docs))).collect()}
    r = got[9]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.spans.count(":") >= 8
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.report(pii.label(pii.find(none))).count() == 0


def test_expectation_maximisation_finds_the_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.4
    right = (0.95, 0.9, 0.6, 0.85)
    votes = sum(np.where((rng.random(len(truth)) < a) == truth, pii.YES, pii.NO) * 3**k for k, a in enumerate(right))
    p = pii.expect(np.bincount(votes, minlength=81).astype(float))
    assert ((p[votes] > 0.5) == truth).mean() > 0.95


# ---- languages ---------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = langid.classify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id")))
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_a_null_id_is_not_held_out(spark):
    df = spark.createDataFrame([(None,), (1,), (3,)], "doc_id long")
    got = {r[0]: r[1] for r in df.select("doc_id", langid.held_out(F.col("doc_id"))).collect()}
    assert got == {None: False, 1: zlib.crc32(b"1") % 4 == 2, 3: zlib.crc32(b"3") % 4 == 2}


def test_language_of_odd_rows(spark, docs, none):
    dictionaries = langid.fit(docs)
    got = {r.doc_id: r for r in langid.classify(docs, dictionaries).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {2, 3, 4} and all(0 <= r.score <= 1 for r in got.values())
    assert langid.keep_known(docs, dictionaries, 0.0).columns == docs.columns
    assert langid.classify(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.classify(docs, {}).collect()} == {"und"}


@pytest.mark.parametrize("ranges", [1, 4, 65_536])
def test_sources_come_near_their_targets(spark, docs, none, ranges):
    """Each source takes the prefix of its documents, in order of their draws, that comes nearest to its target: by brute force, however many ranges; rows of an id go together."""
    rng = np.random.default_rng(5)
    rows = [(k, "abc"[k % 3], int(n)) for k, n in enumerate(rng.lognormal(4, 2, 400))] + [(1000 + k, None, 7) for k in range(9)] + [(2000, "d", 500), (2000, "d", 500), (2001, "d", 0), (2002, "d", 40), (None, "e", 3)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    rates = mixing.source_rates(sized)
    got = {r.source: r.limit for r in mixing.draw_limits(sized, rates, ranges=ranges).collect()}
    number = lambda i: int(hashlib.md5(f"0:{'null' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
    for r in rates.collect():
        mine = [(number(i), n) for i, s, n in rows if s == r.source]
        need = r.target - math.floor(r.rate) * r.source_size
        sums = [0, *(sum(n for d, n in mine if d <= x) for x, _ in mine)]
        assert sum(n for d, n in mine if d <= got[r.source]) == min(sums, key=lambda t: (abs(t - need), t))
    assert mixing.draw_limits(mixing.sizes(none), mixing.source_rates(mixing.sizes(none))).count() == 0


def test_mix_of_the_given_tables_comes_near(spark):
    """Of 50 documents a source, no source is further from its target than half its largest document."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sized = mixing.sizes(table)
    rows = mixing.taken(sized, mixing.plan_mix(sized)).join(table.select("doc_id", "source"), "doc_id")
    for r in rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= min(r.most / 2, 0.03 * r.target)


def test_what_a_worker_remembers_never_changes_ids(monkeypatch):
    """With room for a few pieces only, some are kept and others encoded again; the ids are the library's, and what is met again isn't encoded again."""
    from tokenizers import Tokenizer

    from skillgrid.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    enc, whole, rng, asked = bpe.Encoder(vocabulary()), Tokenizer.from_file(vocabulary()), np.random.default_rng(2), []
    pieces = enc.pieces
    enc.pieces = type("Counted", (), {"encode": lambda self, text, **k: (asked.extend(text.split(" ")), pieces.encode(text, **k))[1]})()
    for size in (12, 12, 90, 12, 0, 12, 12, 12):
        texts = ["the cat don't sit", " ".join(f"w{int(k)}x!" for k in rng.integers(0, 10_000, size)), "日本 the"]
        ids, n = enc.texts(pa.array([*texts, None]))
        assert [ids[a:b].tolist() for a, b in zip(np.cumsum([0, *n]), np.cumsum(n))] == [whole.encode(t, add_special_tokens=False).ids for t in texts] + [[]]
    assert asked.count("cat") < 3


def test_packed_bits(spark):
    """The codes end to end, bit for bit, at all widths and numbers of symbols."""
    rng = np.random.default_rng(8)
    for k in range(300):
        size, n = int(rng.integers(1, 70_000 if k % 60 == 0 else 90)), int(rng.integers(0, 400))
        ids = (rng.zipf(1.2, n) % size).astype(np.uint32)
        lengths = token_store.code_lengths(np.bincount(ids, minlength=size) + (k % 60 == 0))
        codes, width = token_store.canonical(lengths)
        bits, lanes = token_store.pack(ids, codes, lengths, width)
        want = "".join(f"{int(codes[i]):0{width}b}"[: lengths[i]] for i in ids)
        assert bits == bytes(int(want[a : a + 8].ljust(8, "0"), 2) for a in range(0, len(want), 8))
        assert np.frombuffer(lanes, "<u2").tolist() == [int(lengths[ids[a : a + token_store.LANE]].sum()) for a in range(0, n, token_store.LANE)]
