"""The registered queries themselves over whole tables: against their SQL, or against plain versions of what they return."""

import hashlib
import html as html_lib
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from oracle import difference

import corpus_pipeline
from skillgrid.llm import pii
from skillgrid.llm.oracles import OP6
from skillgrid.llm.queries import ORACLES, QUERIES, vocabulary
from skillgrid.session import shared_path

SF = "/root/testdata/sf0.01"


def plain_rows(table="documents", columns="doc_id, text"):
    return duckdb.connect().execute(f"SELECT {columns} FROM '{SF}/{table}.parquet'").fetchall()


def ids_of(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    return [e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), ORACLES[name], SF) == ""


def test_op1(spark):
    rows = sorted(plain_rows())
    want, at = [], 0
    for (i, _), ids in zip(rows, ids_of(t for _, t in rows)):
        ids = [*ids, 1]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(tuple(r[:4]) for r in QUERIES["op1_token_store"](spark, SF).collect()) == want


def test_op3(spark):
    rows = sorted(plain_rows())
    prints = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[a : a + 3]).encode(), 42) for a in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    fp, root = np.array(prints, np.uint64), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fp[:k] ^ fp[k]) <= 3):
            a, b = sorted((find(k), find(int(j))))
            root[b] = a
    want = [(i, f"{p:016x}", rows[find(k)][0]) for k, ((i, _), p) in enumerate(zip(rows, prints))]
    assert sorted(tuple(r[:3]) for r in QUERIES["op3_simhash"](spark, SF).collect()) == want


def test_op7(spark):
    """On these pages the main text is what stands in the article."""
    want = []
    for i, u, page in plain_rows("pages", "page_id, url, html"):
        blocks = re.split(r"</?(?:article|h1|p|br|ul|li|div|blockquote|section)\b[^>]*>", (page or "").partition("<article>")[2].partition("</article>")[0])
        text = " ".join(x for x in (" ".join(html_lib.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks) if x)
        want.append((i, u, text, len(text)))
    assert sorted(tuple(r) for r in QUERIES["op7_main_text"](spark, SF).collect()) == sorted(want)


def test_op8(spark):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    got = {r.doc_id: r for r in QUERIES["op8_personal_data"](spark, SF).collect()}
    for i, text in plain_rows():
        found = []
        for k, (kind, p) in enumerate(patterns.items()):
            for m in re.finditer(p, text or ""):
                digits = re.sub("[^0-9]", "", m[0])
                fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
                found += [(m.start(), k, m.end(), kind)] * bool(fine)
        written = [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == kind for x in found) for kind in patterns]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r.spans.split(",")) | {""}


def test_op9(spark):
    known = dict(plain_rows(columns="doc_id, lang"))
    text = dict(plain_rows())
    got = QUERIES["op9_language"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(known)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text[r.doc_id] or "")))
    judged = [r.lang_pred == known[r.doc_id] for r in got if r.held_out and known[r.doc_id]]
    assert np.mean(judged) > 0.95


def test_op10(spark):
    rows = sorted(plain_rows())
    want = [(i, len((t or "").encode()), len(ids), len(ids) > 2048) for (i, t), ids in zip(rows, ids_of(t for _, t in rows))]
    assert sorted(tuple(r[:4]) for r in QUERIES["op10_token_counts"](spark, SF).collect()) == want


def test_pipeline_stage_by_stage(spark):
    """Each stage on what its predecessor wrote; language and near-dedup have tests of their own beside this one."""
    stages, kept = dict(corpus_pipeline.STAGES), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = f"'{path.removeprefix('file://')}/*.parquet'"
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    con = duckdb.connect()
    rows = lambda name: con.execute(f"SELECT doc_id, text, lang, source FROM {kept[name]} ORDER BY ALL").fetchall()
    whole = con.execute(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY ALL").fetchall()
    assert set(rows("language")) < set(whole) and len(rows("language")) > 0.9 * len(whole)
    # without a window of the benchmark
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [w for w in (fold(t) for (t,) in plain_rows("benchmark", "text")) if w]
    windows = {tuple(w[a : a + 10]) for w in items for a in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = [r for r in rows("near_dedup") if not any(tuple(w[a : a + n]) in windows for w in [fold(r[1])] for n in sizes for a in range(len(w) - n + 1))]
    assert rows("decontaminate") == clean
    # as often as the mix takes them
    sql = OP6.replace("FROM documents", f"FROM {kept['decontaminate']}")
    taken = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, CASE WHEN size > 0 THEN taken // size END FROM ({sql})").fetchall()}
    copies = dict(con.execute(f"SELECT doc_id, count(*) FROM {kept['mix']} GROUP BY 1").fetchall())
    assert {i: copies.get(i, 0) for i, n in taken.items() if n is not None} == {i: n for i, n in taken.items() if n is not None}
    # and read back from the store
    got = stages["token_store"](spark, docs, SF)
    last = sorted((i, t) for i, t, *_ in rows("mix"))
    want, at = [], 0
    for (i, _), ids in zip(last, ids_of(t for _, t in last)):
        raw = struct.pack(f"<{len(ids) + 1}I", *ids, 1)
        want.append((i, at, len(ids) + 1, zlib.crc32(raw)))
        at += len(ids) + 1
    assert sorted(tuple(r[:4]) for r in got.collect()) == want


def test_pipeline_of_odd_tables(spark, docs, none, tmp_path):
    """Nulls, repeated rows and extra columns go through every stage; so does an empty table."""
    for kind, table in (("odd", docs), ("none", none)):
        base = tmp_path / kind
        table.write.parquet(f"{base}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{base}/benchmark.parquet")
        got = corpus_pipeline.run(spark, str(base)).collect()
        assert (len(got) > 0) == (kind == "odd")
