"""Behaviour of the engine's operators on small inputs, and properties that hold for any."""

import io
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import media, text, url
from tessera.functions.similarity import cosine, trigram_list, trigrams, word_similarity
from tessera.operators import chunking, images, ingest, retrieval, state
from tessera.operators import tasks as queue
from tessera.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("size", "overlap", "body"), [(200, 20, "word " * 200), (100, 10, "hello world " * 50), (10, 5, "abcdefghijklmnopqrstuvwxyz"), (100, 0, "a" * 10_000), (30, 5, "一句话。第二句话！第三句？" * 9)])
def test_chunks_of_known_texts(size, overlap, body):
    found = chunking.chunks(body, size, overlap)
    assert len(found) > 1 and all(len(c) <= size + overlap for c in found)
    assert sum(map(len, found)) >= 0.9 * len(body.replace(" ", ""))


@pytest.mark.parametrize("blank", ["", "  \n\t "])
def test_blank_text_has_no_chunks(blank):
    assert chunking.chunks(blank) == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n。！x", max_size=200), st.integers(3, 40), st.integers(0, 10))
def test_chunks_are_parts_of_the_text(body, size, overlap):
    """But for white space: blank pieces go."""
    for c in chunking.chunks(body, size, overlap):
        assert c and "".join(c.split()) in "".join(body.split()) and len(c) <= size + overlap


def test_chunk_documents(spark):
    docs = spark.createDataFrame([(1, "k", "first. " * 400), (2, "k", None), (3, None, " ")], "doc_id long, kb_id string, content string")
    rows = chunking.chunk_documents(docs, 100, 10).collect()
    assert {r.doc_id for r in rows} == {"1"} and sorted(r.chunk_index for r in rows) == list(range(len(rows)))
    assert len({r.chunk_id for r in rows}) == len(rows)


def test_word_similarity_examples():
    assert word_similarity("word", "two words") == pytest.approx(0.8)
    assert word_similarity("", "x") == word_similarity("x", "") == 0.0
    assert word_similarity("two words", "there are two words here") == pytest.approx(1.0)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcd 中", max_size=12), st.text(alphabet="abcd 中", max_size=40))
def test_word_similarity_bounds(q, c):
    s = word_similarity(q, c)
    assert 0 <= s <= 1
    wanted, held = set(trigram_list(q)), set(trigram_list(c))
    if wanted:  # the index never prunes what can reach the threshold
        assert s <= len(wanted & held) / len(wanted) + 1e-12


def test_trigrams_agree(spark):
    for t in ("Two  words", "Ünï-code 中文 x", "", "..."):
        assert sorted(one(spark, trigrams(F.lit(t)))) == sorted(set(trigram_list(t)))


def ranked(spark, *lists):
    rows = [("q", c, k) for k, c in enumerate(lists[0])], [("q", c, k) for k, c in enumerate(lists[1])]
    return [spark.createDataFrame(r, "query_id string, chunk_id string, rank int") for r in rows]


def test_fusion(spark):
    got = {r.chunk_id: (r.rank, r.score) for r in retrieval.fuse(*ranked(spark, "abc", "bad")).collect()}
    assert got["b"][0] < got["c"][0] and got["b"][0] < got["d"][0] and len(got) == 4
    twice = {r.chunk_id: r.score for r in retrieval.fuse(*ranked(spark, "aa", "a")).collect()}
    assert twice["a"] == pytest.approx(1 / 61 + 1 / 62 + 1 / 61)
    single = sorted((r.rank, r.chunk_id) for r in retrieval.fuse(*ranked(spark, "ab", "")).collect())
    assert single == [(0, "a"), (1, "b")]


def test_cosine_of_odd_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, cosine(v(1, 0), v(2, 0))) == pytest.approx(1.0)
    assert one(spark, cosine(v(0, 0), v(1, 0))) is None
    assert one(spark, cosine(F.lit(None).cast("array<double>"), v(1))) is None


def test_vector_search_ties_and_nulls(spark):
    chunks = spark.createDataFrame([("b", "k", [1.0, 0.0]), ("a", "k", [1.0, 0.0]), ("c", "k", None), ("d", "other", [1.0, 0.0]), ("z", "k", [0.0, 0.0])], "chunk_id string, kb_id string, embedding array<float>")
    q = spark.createDataFrame([("q", "k", [1.0, 0.0])], "query_id string, kb_id string, embedding array<float>")
    assert [r.chunk_id for r in retrieval.vector_search(q, chunks, 5).orderBy("rank").collect()] == ["a", "b"]


def test_keyword_search_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["alpha", "beta", "gamma", "alphabet", "betas", "中文", "gam"]
    rows = [(str(i), "k", " ".join(rng.choice(vocab) for _ in range(12))) for i in range(80)]
    queries = [(f"q{i}", "k", " ".join(rng.choice(vocab) for _ in range(2))) for i in range(10)]
    got = retrieval.keyword_search(spark.createDataFrame(queries, "query_id string, kb_id string, query string"), spark.createDataFrame(rows, "chunk_id string, kb_id string, content string"), 100)
    expected = {(q, c) for q, _, t in queries for c, _, x in rows if word_similarity(t, x) >= 0.6}
    assert {(r.query_id, r.chunk_id) for r in got.collect()} == expected


def test_answers(spark):
    queries = spark.createDataFrame([("q1", "x"), ("q2", "y")], "query_id string, query string")
    hits = spark.createDataFrame([("q1", "a", 0.5, 0), ("q1", "b", 0.4, 1)], "query_id string, chunk_id string, score double, rank int")
    chunks = spark.createDataFrame([("a", "d1", "A"), ("b", "d2", "B")], "chunk_id string, doc_id string, content string")
    got = {r.query_id: r for r in retrieval.assemble(queries, hits, chunks, lambda q, c: F.concat(q, F.lit("!"))).collect()}
    assert got["q1"].context == "[1] A\n\n[2] B" and got["q1"].answer == "x!" and [s.chunk_id for s in got["q1"].sources] == ["a", "b"]
    assert got["q2"].answer == retrieval.NO_RESULTS and got["q2"].context == ""


def test_strip_and_titles(spark):
    assert one(spark, text.strip(F.lit("　 a b\t\n"))) == "a b"
    assert one(spark, text.text_title(F.lit("\n  First line\nsecond"), F.lit(""))) == "First line"
    assert one(spark, text.text_title(F.lit("x"), F.lit(" Given "))) == "Given"
    assert len(one(spark, text.text_title(F.lit("y" * 200), F.lit(None)))) == 80
    assert one(spark, text.text_title(F.lit(" \n "), F.lit(None))).startswith("text-")
    assert one(spark, text.html_title(F.lit("<title>  </title>"), F.lit("host"))) == ""
    assert one(spark, text.html_title(F.lit("<p>"), F.lit("host"))) == "host"


@pytest.mark.parametrize(
    ("page", "title", "blocked"),
    [("<p>hi</p>", "安全验证", True), ("<p>Please complete the captcha</p>", "", True), ("<p>" + "words " * 200 + "captcha</p>", "", False), ("<!-- captcha --><p>ok</p>", "", False), ("<p>Just a moment...</p>", "x", True)],
)
def test_block_pages(spark, page, title, blocked):
    assert (one(spark, text.block_reason(F.lit(page), F.lit(title))) is not None) == blocked


@pytest.mark.parametrize(("ip", "private"), [("10.1.2.3", True), ("8.8.8.8", False), ("100.100.100.200", True), ("::1", True), ("2001:4860::8888", False), ("fe80::1", True), ("255.255.255.255", True)])
def test_private_addresses(ip, private):
    assert url.is_private(ip) == private


@pytest.mark.parametrize(("w", "h", "ratio"), [(1920, 1080, "16:9"), (0, 5, ""), (None, 5, ""), (100, 100, "1:1"), (7, 1, "7:1"), (1000, 663, "3:2")])
def test_aspect_ratio(spark, w, h, ratio):
    assert one(spark, media.aspect_ratio(F.lit(w).cast("int"), F.lit(h).cast("int"))) == ratio


@pytest.mark.parametrize(("s", "said"), [(47, "47 秒"), (337, "5 分 37 秒"), (300, "5 分"), (4980, "1 小时 23 分"), (3600, "1 小时"), (-5, "0 秒")])
def test_durations(spark, s, said):
    assert one(spark, text.duration(F.lit(s))) == said


def test_rfc3339(spark):
    assert one(spark, text.rfc3339(F.lit("0001-01-01T00:00:00Z"))) is None and one(spark, text.rfc3339(F.lit("nonsense"))) is None
    assert one(spark, F.unix_micros(text.rfc3339(F.lit("2024-05-01T10:00:00.123456789Z")))) == 1714557600123456


def test_outline_fences(spark):
    md = "# A\n```\n# no\n```\n## B  \n```\n# open"
    rows = images.outline(spark.createDataFrame([(1, md), (2, "")], "doc_id long, content string")).orderBy("line").collect()
    assert [(r.level, r.title) for r in rows] == [(1, "A"), (2, "B"), (1, "open")]


def test_image_placement():
    md = "# One\ntext ![alt a](x/a.png) more\n## Two\n![b](b.png)"
    refs = [images.Ref("a.png", 300, 300, 1), images.Ref("b.png", 300, 300, 3), images.Ref("orphan.png", 300, 300, 2), images.Ref("tiny.png", 20, 300, 1), images.Ref("last.png", None, None, 9)]
    got = images.place(md, refs)
    assert [r.name for r in got] == ["a.png", "orphan.png", "b.png", "last.png"]
    assert got[0].alt == "alt a" and got[0].section_title == "One" and got[1].context == "" and got[2].section_title == "Two"


def test_breaker():
    b = state.Breaker(2, 60)
    assert b.step(0, False, True) == ("pass", "closed") and b.step(1, True, True) == ("pass", "closed")
    assert b.step(2, False, True)[1] == "closed" and b.step(3, False, False)[1] == "closed"
    b.step(4, False, True)
    assert b.step(5, False, True) == ("pass", "open") and b.step(6, True, True) == ("reject", "open")
    assert b.step(66, False, True) == ("pass", "open") and b.step(70, True, True)[0] == "reject" and b.step(130, True, True) == ("pass", "closed")


def test_limiter():
    x = state.Limiter(2, 10)
    assert [x.step(t) for t in (0, 1, 2, 9, 10, 10.5, 11)] == [True, True, False, False, True, False, True]


def test_stream_breaker_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"n{i % 3}", i, float(i), rng.random() > 0.5, rng.random() > 0.2) for i in range(200)]
    df = spark.createDataFrame(rows, "name string, id long, ts double, ok boolean, counted boolean")
    for k in range(4):  # files in time order, one for each micro-batch
        df.where(f"id >= {k * 50} AND id < {k * 50 + 50}").coalesce(1).write.mode("append").parquet(str(tmp_path))
    from tessera.streaming import windows

    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = windows.run_to_end(windows.breaker_stream(stream, 3, 10.0), "breaker_test")
    want = state.breaker(df, 3, 10.0)
    key = lambda r: (r.name, r.id)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(map(tuple, want.collect()), key=lambda r: r[:2])


def test_queue_steps(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = [("a", "pending", 1, 3), ("b", "running", 3, 3)]
    t = spark.createDataFrame(rows, "id string, status string, attempts int, max_attempts int").withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("locked_until", "finished_at")})
    got = {r.id: r.status for r in queue.fail(t, now).collect()}
    assert got == {"a": "pending", "b": "dead"}
    assert [one(spark, queue.backoff(F.lit(n))) for n in (1, 2, 5, 6, 30)] == [30, 60, 480, 600, 600]


def test_outcomes(spark):
    rows = [
        ("ok", "queued", 1, "x" * 60, 0, False, ""), ("short", "queued", 1, "x", 0, False, ""), ("img", "queued", 1, "x", 2, True, ""), ("perm", "queued", 1, "", 0, False, "permanent"),
        ("second", "queued", 1, "", 0, False, "boom"), ("second", "queued", 2, "x" * 50, 0, False, ""), ("bad", "queued", 1, "", 0, False, ""), ("bad", "queued", 2, None, None, None, "boom"), ("done", "completed", 1, "", 0, False, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id string, status string, attempt int, content string, images int, allow_image_only boolean, error string")
    got = {r.doc_id: (r.new_status, r.index_status, r.error_type, r.raises) for r in ingest.outcome(df).collect()}
    assert got == {
        "ok": ("completed", "completed", None, False), "short": ("failed", "pending", "empty_content", False), "img": ("completed", "skipped", "image_only", False), "perm": ("failed", "pending", "permanent", False),
        "second": ("completed", "completed", None, False), "bad": ("failed", "pending", "parse_error", True), "done": ("completed", None, None, False),
    }


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office_packages(spark):
    doc = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t><w:drawing><a:blip r:embed="r1"/></w:drawing></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x/image" Target="media/gone.png"/></Relationships>'
    broken = package(**{"word/document.xml": doc, "word/_rels/document.xml.rels": rels})
    assert readers.docx_markdown(broken) == ("# Title\n\nBody![](image_0001.png)\n\n| a\\|b |\n| --- |", "Title", 1)
    assert readers.docx_markdown(readers.docx_repair(broken))[2] == 0
    assert readers.docx_repair(b"not a zip") == b"not a zip"
    A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    slide = f"<s {A}><a:p><a:t>Head</a:t></a:p><a:p><a:t>Line</a:t></a:p></s>"
    deck = package(**{"ppt/slides/slide1.xml": slide, "ppt/slides/slide2.xml": f"<s {A}/>", "ppt/notesSlides/notesSlide1.xml": f"<s {A}><a:p><a:t>Say</a:t></a:p></s>"})
    assert readers.pptx_markdown(deck, "deck") == ("# deck\n\n## Slide 1: Head\n\nLine\n\n### Notes\n\nSay\n\n## Slide 2", 2)
    assert readers.slide_count(deck) == 2 and readers.slide_count(b"x") is None
    files = spark.createDataFrame([(1, "a.docx", broken), (2, "d.pptx", deck), (3, "x.docx", b"junk")], "doc_id long, filename string, content binary")
    got = {r.doc_id: r for r in readers.packages(files).collect()}
    assert got[1].title == "Title" and got[2].pages == 2 and got[3].markdown is None and got[3].error


def test_workbook(spark):
    S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = package(**{
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si></sst>", "xl/worksheets/s.xml": f'<worksheet {S}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>3</v></c></row></sheetData></worksheet>',
    })
    rows = readers.workbook_rows(spark.createDataFrame([(1, book)], "doc_id long, content binary"))
    assert readers.sheet_markdown(rows).first().markdown == "## Sheet: One\n\n| name |  | 3 |\n| --- | --- | --- |"


def test_csv_and_uploads(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n"x|y",\n')
    files = readers.uploads(spark, str(tmp_path))
    assert files.first().filename == "t.csv"
    assert readers.csv_tables(files).first().markdown == "| a | b |\n| --- | --- |\n| x\\|y |  |"
    assert readers.whole_texts(spark, str(tmp_path)).first().text.startswith("a,b")


def test_external_client(spark):
    df = spark.createDataFrame([("a",), ("bb",), (None,)], "t string")
    assert sorted(r.v[0] for r in readers.external(df, lambda ts: [[float(len(t))] for t in ts], "t", "v").collect()) == [0.0, 1.0, 2.0]


def test_schema(spark):
    assert {f.name for f in schema.TASKS} >= {"payload", "locked_until"}
    chunks = spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<float>")
    assert schema.check_dimension(chunks, 2).count() == 1
    with pytest.raises(Exception, match="dimension"):
        schema.check_dimension(chunks, 3).collect()
    assert one(spark, schema.in_domain("tasks.status", F.lit("dead"))) and not one(spark, schema.in_domain("tasks.status", F.lit("zombie")))


def test_sites():
    from tessera.sources import sites

    note = '<title>Note - 小红书</title><div class="author-desc-wrapper">no</div><div class="author-desc"><i class="author-desc-trigger">展开</i> the body</div><img data-src="https://a.xhscdn.com/1"><img src="https://a.xhscdn.com/1"><img src="https://a.xhscdn.com/Avatar/2"><img src="https://other.example/3">'
    assert sites.xhs(note) == ("Note", "the body", ["https://a.xhscdn.com/1"])
    assert sites.xhs('<meta property="og:title" content="OG"><div id="detail-desc">old</div>') == ("OG", "old", [])
    assert sites.is_video_note("https://x/1?a=1&type=video#f") and not sites.is_video_note("https://x/1?xtype=video&type=video2")
    post = '<div id="js_image_content"><h1 class="t">Pics</h1><div class="box"><img data-src="cover"></div></div><div id="js_image_desc">said <img data-src="in"></div>'
    assert sites.wechat(post) == ("Pics", "said", ["cover", "in"])
    assert sites.wechat("<p>nothing</p>") == ("", "", [])
    entry = "<title>X_百度百科</title><script>var para_ = 1</script><p>目录 1 甲 2 乙 播报 short 编辑</p>"
    assert sites.baike(entry)[:2] == ("X", "X_百度百科 short")
    assert sites.baike_card('{"newLemmaId": 5, "abstract": " a ", "desc": "d", "image": "i"}', 5, "k") == ("k", "d\n\na", ["i"])
    assert sites.baike_card('{"newLemmaId": 6, "abstract": "a"}', 5, "k") is None and sites.baike_card("junk", None, "k") is None
    html = f'<img src="https://{sites.FEISHU_IMAGE_HOST}/a"><img src="https://x.feishucdn.com/b"><img src="data:z">'
    assert sites.feishu_images(html) == [f"https://{sites.FEISHU_IMAGE_HOST}/a"]
    assert sites.named_images("t ![](u1)", ["u1", "u2"], ["1.png", "2.png"]) == "t ![](1.png)\n\n![](2.png)"


def test_object_store(spark, tmp_path):
    from tessera.sources.store import ObjectStore

    store = ObjectStore(spark, f"file://{tmp_path}")
    store.put("a/b.bin", b"\x00\xff")
    store.put("a/c.bin", b"")
    assert store.get("a/b.bin") == b"\x00\xff" and store.exists("a/c.bin")
    assert store.delete("a/c.bin") and not store.exists("a/c.bin")
    assert store.delete_prefix("a") == 1 and store.delete_prefix("none") == 0


def test_near_images_of_all_rows(spark, tmp_path):
    """Every near pair, ids from 1200 on included, follows from classes and pairs of representatives."""
    from tessera.plans import search

    ids = [*range(0, 1300, 13), *range(1200, 1260), *range(5000, 5040), 2400, 4801]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    hashes = {r.id: int(r.phash, 16) for r in search._hashes(spark, str(tmp_path)).collect()}
    want = {(a, b, (hashes[a] ^ hashes[b]).bit_count()) for a in hashes for b in hashes if a < b and (hashes[a] ^ hashes[b]).bit_count() <= 5}
    rows = [tuple(r) for r in search.near_images(spark, str(tmp_path)).collect()]
    rep = {i: i for i in hashes} | {b: a for a, b, bits in rows if bits == 0}
    bits = {(a, b): n for a, b, n in rows if n}
    apart = lambda a, b: 0 if rep[a] == rep[b] else bits.get((min(rep[a], rep[b]), max(rep[a], rep[b])))
    assert {(a, b, apart(a, b)) for a in hashes for b in hashes if a < b and apart(a, b) is not None} == want
    assert any(a >= 1200 for a, _, _ in want) and len(rows) < len(want)


def test_due_queries(spark, tmp_path):
    """Every row whose id is divisible by 50 is a query."""
    import math

    from tessera.plans import search

    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)] if i % 9 else [1.0, 0.0, 0.0, 0.0], i % 2) for i in range(0, 400, 10)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    want = []
    for q, e, kb in rows:
        if q % 50 == 0:
            near = sorted((-round(cos(e, c), 6), i) for i, c, k in rows if k == kb and any(c) and any(e))[:10]
            want += [(q, -s, r) for r, (s, _) in enumerate(near)]
    got = search.vector_topk(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, round(r.score, 6), r["rank"]) for r in got) == sorted(want)
    due = {0, 50, 100, 150, 200, 250, 300, 350}
    for q in (search.vector_topk_batched, search.rrf_fusion, search.rerank_top, search.context_assembly):
        assert {r.query_id for r in q(spark, str(tmp_path)).collect()} == due


def test_searches_read_all_documents(spark, tmp_path):
    """Documents of any source, language and none are found."""
    from tessera.plans import search

    docs = [(0, "alpha beta gamma here", "src0", "en"), (1, "so alpha beta gamma", "elsewhere", "de"), (2, "alpha beta gamma too", None, None), (3, "nothing of it", "src1", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "alpha beta gamma delta"), (7, "nothing of it all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    queries, chunks = search._corpus(spark, str(tmp_path))
    made, asked = chunks.collect(), queries.collect()
    want = {(q.query_id, c.chunk_id) for q in asked for c in made if word_similarity(q.query, c.content) >= 0.6}
    assert len(want) == 4
    assert {(r.query_id, r.chunk_id) for r in search.keyword_search(spark, str(tmp_path)).collect()} == want
    assert {(r.query_id, r.chunk_id) for r in search.hybrid_search(spark, str(tmp_path)).collect()} == {(q.query_id, c.chunk_id) for q in asked for c in made}


def test_evaluation_and_image_context_read_all(spark, tmp_path):
    """Documents from 1000 on can be hits; images stand in the whole text."""
    from tessera.plans import search

    n = 1500
    rows = [(i, f"hit {i}" if i in (1003, 1254) else f"no {i}") for i in range(n - 1)] + [(n - 1, "x" * 700 + "y" * 901)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(40, "hit me"), (50, "hit me"), (61, "hit me")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.query_id: r.hit_rank for r in search._hits(spark, str(tmp_path)).collect()} == {40: 4, 50: 5, 61: None}
    row = search.eval_hits(spark, str(tmp_path)).first()
    assert (row.queries, row.hit_5, row.mrr) == (3, round(2 / 3, 6), round((1 / 4 + 1 / 5) / 3, 6))
    assert sorted((r.tier, r.hit_5) for r in search.eval_by_tier(spark, str(tmp_path)).collect()) == [(1, 0.5), (2, 1.0)]
    at = {r.name: r.position for r in search.image_context(spark, str(tmp_path)).where(f"doc_id = {n - 1}").collect()}
    assert at["a.png"] == len("# Top\n") + 800 + 1 and at["b.png"] > 1600


def test_resolve_like_the_standard_library(spark):
    from urllib.parse import urljoin

    from tessera.functions import url

    bases = ["https://a.example", "https://a.example/", "https://a.example/x", "https://a.example/x/y/z.html?q=1#f", "http://b.example:81/p/"]
    refs = ["a.png", "/a.png", "//c.example/a", "https://d.example/b", "../a", "../../../a", "./a", "b/./c/../d", "?k=v", "#top", "a?x=../y", "..", "."]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    got = {(x.b, x.r): x.u for x in df.select("b", "r", url.resolve(F.col("b"), F.col("r")).alias("u")).collect()}
    assert got == {(b, r): urljoin(b, r) for b in bases for r in refs}


def test_addresses_of_both_families(spark):
    import ipaddress

    rng = random.Random(5)
    rows = ["::", "::1", "fe80::1", "::ffff:10.0.0.1", "1:2:3:4:5:6:7::", "1::2::3", "1:2", "g::1", ":1::2", "1:2:3:4:5:6:7:8:9", "1:2:3:4::5:6:7:8", "12345::", "10.1.2.3", "256.1.1.1", "", None, "::1.2.3.999", "FF02::FB"]
    for _ in range(200):
        a = ipaddress.IPv6Address(rng.getrandbits(128) & ~(((1 << 16 * rng.randint(0, 6)) - 1) << 16) if rng.random() < 0.7 else rng.getrandbits(128))
        rows += [a.compressed, a.exploded]
    got = {r.ip: r.range for r in url.blocked_addresses(spark.createDataFrame([(i,) for i in set(rows)], "ip string")).collect()}

    def expected(ip):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return None
        return next((n for n in url.PRIVATE_RANGES if a in ipaddress.ip_network(n)), None)

    assert got == {i: expected(i) for i in set(rows)}


def test_known_kbs(spark):
    requests = spark.createDataFrame([("a", "k1"), ("b", "k2"), ("c", None)], "id string, kb_id string")
    known, missing = ingest.known_kbs(requests, spark.createDataFrame([("k1",), ("k1",), (None,)], "kb_id string"))
    assert [r.id for r in known.collect()] == ["a"]
    assert sorted((r.id, r.status_code) for r in missing.collect()) == [("b", 404), ("c", 404)]


DIGEST = "id string, source string, storage_key string, status string, error_type string, error_msg string, parse_engine string, created_at timestamp_ntz"


def digest_message(spark, rows, **more):
    from datetime import datetime

    docs = spark.createDataFrame([(*r, datetime(2024, 1, 2, 0, k)) for k, r in enumerate(rows)], DIGEST)
    return queue.digest_text(queue.digest(docs, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")), 24, **more).collect()[0].text


def test_digest_messages(spark):
    assert digest_message(spark, []) == "过去 24 小时入库样本：0（无新增）"
    assert digest_message(spark, [("a", "u", "", "completed", None, "", "x")] * 2, env="prod") == "[prod] 过去 24 小时入库样本\n🔗 链接 2 个 ✅ 全部成功"
    rows = [("a", "s" * 90, "k", "failed", "too_large", "m" * 130, ""), ("b", None, None, "failed", "odd", None, "paddle"), ("c", "u", "", "failed", "odd", "why", "paddle"), *[("d", "u", "", "completed", None, "", "x")] * 6]
    assert digest_message(spark, rows).split("\n") == [
        "过去 24 小时入库样本", "📄 文件 1 个（失败 1，成功率 0%）", "🔗 链接 8 个（失败 2，成功率 75%）", "", "按类型：• odd×2  📦 too_large×1", "按引擎：paddle×2  unknown×1", "", "最近 3 个样本：",
        "• [paddle] u", "   why", "• [paddle] (empty)", "   ", "📦 [unknown] " + "s" * 79 + "…", "   " + "m" * 120,
    ]


def test_fetch_tiers(spark):
    long = "word " * 90
    rows = [
        (1, "https://h/p", "http", 200, "text/html", long, False), (1, "https://h/p", "browser", 200, None, "later", False),
        (2, "https://h/p", "http", 200, None, long, True), (2, "https://h/p", "impersonated", 200, None, "x", None),
        (3, "https://a.instagram.com/p", "http", 404, None, long, False), (3, "https://a.instagram.com/p", "browser", 200, None, " ", False),
        (4, "https://h/p", "http", 200, "application/pdf", None, False), (5, "https://h/p", "http", None, None, None, None), (6, None, "http", 410, None, None, None),
    ]
    got = {r.url_id: (r.tier, r.outcome) for r in state.fetch_tiers(spark.createDataFrame(rows, "url_id long, url string, tier string, status int, content_type string, content string, blocked boolean")).collect()}
    assert got == {1: ("http", "ok"), 2: ("impersonated", "ok"), 3: ("browser", "empty"), 4: ("http", "pdf"), 5: (None, "unfinished"), 6: ("http", "gone")}


def test_vision_text(spark):
    assert one(spark, readers.vision_markdown(F.lit("pic"), F.lit(" ## Description\nA\n"))) == "# pic\n\n## Description\nA\n"
    assert one(spark, readers.vision_markdown(F.lit(""), F.lit("x"))) == "# image\n\nx\n"
    assert one(spark, readers.vision_markdown(F.lit("pic"), F.lit(" \n"))) is None


def test_external_retries(spark, tmp_path):
    class Refused(Exception):
        def __init__(self, status_code):
            self.status_code = status_code

    for status, passes in ((429, True), (503, True), (400, False), (None, False)):
        assert readers.passing(Refused(status)) == passes
    assert readers.passing(TimeoutError()) and not readers.passing(ValueError())
    seen = str(tmp_path / "seen")

    def call(texts):
        with open(seen, "a") as f:
            f.write("x")
        if len(open(seen).read()) < 3:
            raise ConnectionError("once more")
        return [[1.0] for _ in texts]

    assert readers.external(spark.createDataFrame([("a",)], "t string"), call, "t", "v", pause=0.01).collect()[0].v == [1.0]
    assert open(seen).read() == "xxx"


def test_document_package_details():
    number = '<w:numbering xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    item = lambda n, level, t: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{n}"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    runs = '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">bold </w:t></w:r><w:r><w:rPr><w:i/></w:rPr><w:t>it</w:t></w:r><w:hyperlink r:id="r2"><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><a:blip r:embed="r1"/></w:r></w:p>'
    doc = f'<w:document {W}><w:body>{item(7, 0, "one")}{item(7, 0, "two")}{item(8, 1, "sub")}{runs}{item(8, 0, "dot")}</w:body></w:document>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x/image" Target="media/a.JPEG"/><Relationship Id="r2" Type="x/hyperlink" Target="https://h/"/></Relationships>'
    content = package(**{"word/document.xml": doc, "word/numbering.xml": number, "word/_rels/document.xml.rels": rels, "word/media/a.JPEG": b"bytes"})
    assert readers.docx_markdown(content, "s") == ("1. one\n1. two\n    - sub\n\n**bold** *it*[link](https://h/)![](image_0001.jpeg)\n\n- dot", "s", 1)
    assert readers.docx_images(content) == [("image_0001.jpeg", b"bytes")]


def test_main_content():
    from tessera.sources.sites import main_content

    prose = "A sentence that says something. " * 6
    page = f"<title>t</title><nav>menu</nav><h2>Head</h2><p>{prose}</p><ul><li><a href=x>all a link</a></li><li>item</li></ul><script>no()</script><img src=i.png><footer>foot</footer>"
    assert main_content(page) == f"## Head\n\n{prose.strip()}\n\n- item\n\n![](i.png)"
    assert main_content(f"<div>advert</div><article><p>{prose}</p></article>") == prose.strip()
    assert main_content(f"<article><p>{prose}</p></article>" * 3).count(prose.strip()) == 3
    linked = "".join(f"<p><a>{w} linked words</a></p>" for w in "abcdefghijklmnopqrstuvwxyz")
    assert main_content(f"<p>side</p><div class='x entry-content'>{linked}</div>").startswith("a linked words\n\nb linked")
    assert main_content("<style>x</style><nav>only</nav><p>short</p>") == "only\n\nshort"
    assert main_content("") == "" and main_content("<div>" * 20_000 + "deep") == "deep"


def test_sheet_limits(spark):
    rows = [(1, "s", k, [c, "x", "y"]) for k, c in enumerate(["", "a", "", "b", "c", ""], 1)] + [(1, "blank", 1, [" ", None])]
    rows = [(d, s, k, [c[0], *(["", ""] if not c[0] else c[1:])] if len(c) == 3 else c) for d, s, k, c in rows]
    got = readers.sheet_markdown(spark.createDataFrame(rows, "doc_id long, sheet string, row int, cells array<string>"), 2, 2).collect()
    assert [r.markdown for r in got] == ["## Sheet: s\n\n| a | x |\n| --- | --- |\n|  |  |\n\n_2 of 4 rows shown_"]
