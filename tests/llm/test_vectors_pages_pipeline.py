from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest
from helpers import odd_documents
from pyspark.sql import functions as F

import corpus_pipeline
from regatta.llm import html_blocks, language_id, near_vectors, pii, queries, simhash, warc_index
from regatta.llm.common import local_components

# -- vectors --------------------------------------------------------------------------------------


def planted(n=900, groups=12, width=24, seed=3):
    """Far-apart vectors, groups of near copies, one large dense group, and exact copies."""
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, width))
    for g in range(groups):
        size = 220 if g == 0 else 5
        at = rng.choice(n, size, False)
        points[at] = points[at[0]] + 0.12 * rng.normal(size=(size, width))
    points[::50] = points[1]
    return points


@pytest.mark.parametrize("shape", [{}, {"shard_nodes": 90, "block_nodes": 40}])
def test_links_and_components_equal_brute_force(spark, shape):
    points = planted()
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    result = near_vectors.near_duplicate_vectors(frame, **shape)
    found = {r["vec_id"]: r for r in result.collect()}
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = unit @ unit.T >= near_vectors.COSINE
    true = near.sum(axis=1) - 1
    got = np.array([found[i]["n_links"] for i in range(len(points))])
    assert (got == true).all()
    assert near_vectors.audit_recall(frame, result) == 1.0
    label = local_components(len(points), *np.nonzero(near))
    assert [found[i]["component_id"] for i in range(len(points))] == label.tolist()
    assert all(found[i]["kept"] == (found[i]["component_id"] == i) for i in range(len(points)))


def test_sql_states_planted_links(spark):
    """The SQL of the query on vectors that do link, with null, zero and broken ones."""
    import duckdb
    import pandas as pd

    points = [*planted(400, 4, 24).tolist(), None, [0.0] * 24, [float("nan")] + [1.0] * 23]
    vectors = pd.DataFrame({"vec_id": range(len(points)), "embedding": points})
    con = duckdb.connect()
    con.register("raw", vectors)
    con.execute("CREATE VIEW embeddings AS SELECT vec_id, embedding::DOUBLE[] AS embedding FROM raw")
    want = con.execute(queries.OP2_SQL).fetchall()
    frame = spark.createDataFrame(list(enumerate(points)), "vec_id long, embedding array<double>")
    found = near_vectors.near_duplicate_vectors(frame).select("vec_id", "n_links", "component_id", "kept")
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sum(r[1] for r in want) > 20


@pytest.mark.parametrize("n", [1500, 6000])
def test_a_dense_group_over_many_shards_keeps_all_links(spark, n):
    rng = np.random.default_rng(11)
    points = rng.normal(size=(n, 64))
    points[: n // 3] = points[0] + 0.15 * rng.normal(size=(n // 3, 64))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = near_vectors.near_duplicate_vectors(frame, shard_nodes=60, block_nodes=128).collect()
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    true = (unit @ unit.T >= near_vectors.COSINE).sum(axis=1) - 1
    assert {r["vec_id"]: r["n_links"] for r in found} == dict(enumerate(true.tolist()))


def test_lone_pairs_beside_a_dense_group_in_one_shard_are_found(spark):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(2000, 64))
    points[:1400] = points[0] + 0.15 * rng.normal(size=(1400, 64))
    points[1401::2] = points[1400::2] + 0.15 * rng.normal(size=(300, 64))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = near_vectors.near_duplicate_vectors(frame, shard_nodes=4000).collect()
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    true = (unit @ unit.T >= near_vectors.COSINE).sum(axis=1) - 1
    assert (true[1400:] == 1).all()
    assert {r["vec_id"]: r["n_links"] for r in found} == dict(enumerate(true.tolist()))


def test_given_embeddings_with_copies(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    copies = given.where("vec_id % 5 = 0").withColumn("vec_id", F.col("vec_id") + 10_000)
    rows = {r["vec_id"]: r for r in near_vectors.near_duplicate_vectors(given.unionByName(copies)).collect()}
    for i, r in rows.items():
        assert r["component_id"] == (i - 10_000 if i >= 10_000 else i)
        assert r["n_links"] == (1 if i >= 10_000 or i % 5 == 0 else 0)


def test_unusable_vectors_link_with_nothing(spark):
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [None, 1.0], 0), (5, [float("nan"), 1.0], 0),
            (6, [float("inf"), 1.0], 0), (7, [1.0, 0.0], 0), (8, [2.0, 0.01], 0), (8, [1.0, 0.0], 0),
            (None, [1.0, 0.0], 0), (9, [1.0, 0.0, 0.0], 0), (10, [0.0, 1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int")
    found = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"])
                   for r in near_vectors.near_duplicate_vectors(frame).collect())
    assert found == sorted(
        [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10)]
        + [(7, 3, 7, True), (8, 3, 7, False), (8, 3, 7, False), (0, 3, 7, False)]
    )
    assert near_vectors.near_duplicate_vectors(frame.limit(0)).count() == 0


# -- archives -------------------------------------------------------------------------------------


def odd_pages(spark):
    rows = [
        (3, "http://www.B.example.com:80/x?b=2&a=1", "<p>one</p>"), (1, "https://a.example.com/", "<p>one</p>"),
        (2, None, None), (4, "http://a.example.com/p%0Aq\nr", ""), (None, "not a url", "<p>one</p>"),
        (5, "http://c.example.org", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n é😀"), (1, "https://a.example.com/", "<p>one</p>"),
        (6, "http://c.example.org", None), (7, "http://[bad", "y" * 200_000),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(1))


def test_archives_read_back_whole(spark, tmp_path):
    pages = odd_pages(spark)
    archives, index = warc_index.archive_pages(pages, f"file://{tmp_path}/w")
    read = [(r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
            for r in warc_index.read_index(spark, index).collect()]
    smallest, expected = {}, []
    for r in pages.collect():
        html = r["html"] or ""
        if r["page_id"] is not None:
            smallest[html] = min(smallest.get(html, r["page_id"]), r["page_id"])
    for r in pages.collect():
        data = (r["html"] or "").encode()
        refers = None if r["page_id"] == smallest[r["html"] or ""] else smallest[r["html"] or ""]
        expected.append((r["page_id"], r["url"], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                         "revisit" if refers is not None else "response", refers))
    assert sorted(map(repr, read)) == sorted(map(repr, expected))
    lookup = warc_index.CaptureIndex(spark, index)
    lines = lookup.find("https://c.example.org/")
    assert [x["page_id"] for x in lines] == [5, 6] and lookup.find("http://nowhere.example") == []
    record = lookup.fetch(lines[0])
    assert record.payload.decode().endswith("é😀") and record.headers["X-Page-Id"] == "5"


def test_a_hot_url_fills_many_blocks(spark, tmp_path):
    pages = spark.range(500).selectExpr(
        "id AS page_id", "if(id % 3 = 0, 'http://hot.example/', concat('http://h', id, '.example/')) AS url",
        "cast(id AS string) AS html")
    warc_index.write_archives(pages, f"file://{tmp_path}/a", file_records=((1, 40), (2, 30)))
    warc_index.write_index(warc_index.read_archives(spark, f"file://{tmp_path}/a"), f"file://{tmp_path}/i", 20)
    lookup = warc_index.CaptureIndex(spark, f"file://{tmp_path}/i")
    assert sorted(x["page_id"] for x in lookup.find("http://hot.example/")) == list(range(0, 500, 3))
    assert [x["page_id"] for x in lookup.find("http://h7.example/")] == [7] and len(lookup.directory) >= 20
    assert lookup.fetch(lookup.find("http://h7.example/")[0]).payload == b"7"
    none = pages.limit(0)
    assert warc_index.read_index(spark, warc_index.archive_pages(none, f"file://{tmp_path}/e")[1]).count() == 0


def test_many_look_ups_in_tasks(spark, tmp_path):
    """A hot URL over many blocks and parts, repeated captures, null ids and URLs, ids that are not there."""
    pages = spark.range(600).selectExpr(
        "if(id = 599, null, if(id = 598, 597, id)) AS page_id",
        "CASE WHEN id IN (5, 599) THEN null WHEN id % 3 = 0 OR id > 596 THEN 'http://hot.example/' "
        "ELSE concat('http://h', id, '.example/') END AS url",
        "if(id % 7 = 0, 'same', repeat(cast(id AS string), cast(id AS int) + 1)) AS html")
    root = f"file://{tmp_path}"
    warc_index.write_archives(pages, f"{root}/a", ((50, 40), (900, 9)))
    warc_index.write_index(warc_index.read_archives(spark, f"{root}/a"), f"{root}/i", 20)
    warc_index.write_directory(spark, f"{root}/i", f"{root}/d")
    absent = spark.createDataFrame([(9999, "http://hot.example/"), (1, "http://zzz.example/")], "page_id long, url string")
    answers = warc_index.look_up(
        spark, f"{root}/a", f"{root}/i", f"{root}/d", pages.select("page_id", "url").unionByName(absent)).collect()
    assert all(r["sound"] for r in answers)
    got = sorted(-1 if r["page_id"] is None else r["page_id"] for r in answers)
    assert got == sorted([-1, *range(598), 597])
    ids = [r.headers["WARC-Record-ID"] for f in spark.read.format("binaryFile").load(f"{root}/a").collect()
           for r in warc_index.parse_records(bytes(f["content"]))]
    assert len(set(ids)) == 600
    none = pages.limit(0)
    archives, index = warc_index.archive_pages(none, f"{root}/e")
    assert warc_index.look_up(spark, archives, index, warc_index.directory_of(index), pages).count() == 0


def test_a_spoilt_record_is_not_sound(spark):
    import pandas as pd

    record = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:{}\r\nX-Page-Id: 7\r\n"
              "Content-Length: 1\r\n\r\nx\r\n\r\n")
    digest = base64.b32encode(hashlib.sha1(b"x").digest()).decode()
    rows = [(record.format(digest).encode(), 7, digest), (record.format(digest).encode(), 8, digest),
            (record.format("A" * 32).encode(), 7, "A" * 32)]
    frame = pd.DataFrame(rows, columns=["record", "page_id", "payload_digest"]).assign(record_type="response")
    assert next(warc_index._sound(iter([frame])))["sound"].tolist() == [True, False, False]


def test_given_pages(spark, sf_dir):
    rows = {r["page_id"]: r for r in queries.op6_warc(spark, sf_dir).collect()}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        data = p["html"].encode()
        assert rows[p["page_id"]]["payload_bytes"] == len(data)
        assert rows[p["page_id"]]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- main text ------------------------------------------------------------------------------------


def test_tree_tells_the_labelled_blocks_apart():
    points, marks = html_blocks.labelled_blocks()
    tree = html_blocks.fit_tree(points, marks)
    assert (html_blocks.is_article(tree, points) == (marks > 0)).all()


def test_given_pages_give_their_articles(spark, sf_dir):
    import html
    import re

    for r in queries.op10_html(spark, sf_dir).join(
            spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        plain = html.unescape(re.sub("<b>", "", re.sub("<(?:/?p|br|/?h1)>", " ", article)))
        assert r["text"] == " ".join(plain.split()) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("page, text", [
    ("<nav><a href=x>Home</a></nav><article><header><h1>T &amp; x</h1></header><p>a<b>b</b>c&nbsp;d  e\n f</p>"
     "<div class='ad'>Buy now</div><aside>More</aside><form>Sub<input></form><script>1<2</script>"
     "<section class=comments><p>nice</p></section></article><footer>f</footer>", "T & x abc d e f"),
    ("<article><p>open <p>two<br>three <a href=q>link</a></article><div class=\"cookie-banner\">We use</div>",
     "open two three link"),
    ("<article><p title='a>b'>q</p></article>", "q"), ("", ""), (None, ""), ("<", ""), ("<!-- x", ""), ("<script>", ""),
    ("<article>" + "<div>" * 3000 + "<p>deep</p></article>", "deep"), ("<article><p>" + "w " * 50_000, ("w " * 50_000).strip()),
])
def test_pages_of_all_kinds(page, text):
    tree = html_blocks.fit_tree(*html_blocks.labelled_blocks())
    assert html_blocks.main_text(page, tree) == text


@pytest.mark.parametrize("page, text", [
    ("<script>for(i=0;i<n;i++)x()</script><article>Text</article>", "Text"),
    ("<article><p>One</p><SCRIPT>if(a<b)document.write('<div>')</SCRIPT ><p>Two</p></article>", "One Two"),
    ("<html><head><title>a<b</title><style>x<y{}</style><script>a<b</script><body><article><p>It rained.</p></article>",
     "It rained."),
    ("<head><title>t</title><meta name=x><noscript><p>no</p></noscript><link rel=y><article><p>It rained.</p></article>",
     "It rained."),
    ("<head><script>i<n</head><article>x</article>", ""),
    ("<head><title>t</title></head><body><article><p>It rained.</p></article></body>", "It rained."),
])
def test_raw_text_and_a_head_without_an_end_lose_nothing(page, text):
    tree = html_blocks.fit_tree(*html_blocks.labelled_blocks())
    assert html_blocks.main_text(page, tree) == text


@pytest.mark.parametrize("page, text", [
    ("<article><p class='ad'>Buy now<p>It rained.<p>All day.</article>", "It rained. All day."),
    ("<article><p class=ad>Buy now<div>It rained.</div></article>", "It rained."),
    ("<article><ul><li>One<li class='comment'>Nice<ul><li>Indeed</ul><li>Two</ul><p>End.</article>", "One Two End."),
    ("<article><table><tr><td class='sidebar'>Most read<td>Rain<tr class='promo'><td>Shop<tr><th>Sun</table></article>",
     "Rain Sun"),
    ("<article><dl><dt class=ad>Buy<dd>Rain<dd role='complementary'>More<dt>Sun</dl></article>", "Rain Sun"),
])
def test_named_paragraphs_items_and_cells_are_around(page, text):
    tree = html_blocks.fit_tree(*html_blocks.labelled_blocks())
    assert html_blocks.main_text(page, tree) == text


# -- pipeline -------------------------------------------------------------------------------------


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "language_id", "simhash_near_dedup", "pii", "packing"]
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in seen.collect()}
        after = stage(spark, seen, sf_dir)
        rows = after.collect()
        ids = {r["doc_id"] for r in rows}
        if name != "packing":
            assert after.columns == docs.columns and len(ids) == len(rows)
        if name == "quality_rules":
            judged = queries.op1_quality_rules(spark, sf_dir).where("kept").collect()
            assert ids == {r["doc_id"] for r in judged}
        if name == "language_id":
            assert ids == {i for i, r in before.items() if language_id.gram_counts(r["text"]) is not None}
        if name == "simhash_near_dedup":
            classes = simhash.near_duplicate_classes(seen).collect()
            assert ids == {r["rep"]["doc_id"] for r in classes}
        if name == "pii":
            assert ids == set(before)
            marked = {r["doc_id"] for r in rows if r["text"] != before[r["doc_id"]]["text"]}
            assert marked == {r["doc_id"] for r in pii.report(seen).where("spans <> ''").collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "packing":
            assert ids == set(before)
        seen = after


def test_pipeline_of_odd_and_empty_documents(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, quality int")
    docs = odd_documents(spark)
    for name, part in (("odd", docs), ("empty", docs.limit(0))):
        part.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r["doc_id"] for r in rows} >= {5, 9, (1 << 60) + 1} and not {1, 2, 6, 7, 8} & {r["doc_id"] for r in rows}
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
