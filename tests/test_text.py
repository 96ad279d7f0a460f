from pyspark.sql import functions as F

from lorekeel.functions import columns as c
from lorekeel.operators import budget, detection, segments
from lorekeel.sources import readers
from tests.conftest import rows


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document_id string, text string")


def dictionary(spark, pairs):
    return spark.createDataFrame(pairs, "alias string, entity_id string")


DICT = [("york", "Y"), ("new york", "N"), ("new york times", "T"), ("u.s.", "U"), ("apple", "A1"), ("apple", "A2"), ("aa aa", "D"), ("éa", "E")]
TEXTS = ("New York and the New York Times", "apple_pie, pineapple; Apple.", "U.S. and u.s.a", "aa aa aa", "éa ÉA réa", "york", "", None, "new yorker")


def test_both_plans_of_detection_agree_and_report_whole_aliases(spark):
    d, t = dictionary(spark, DICT), docs(spark, *TEXTS)
    a, b = rows(detection.detect(t, d)), rows(detection.detect_by_automaton(t, d))
    assert a == b
    assert ("0", "york", 4, 8) in a and ("0", "new york", 0, 8) in a and ("0", "new york times", 17, 31) in a
    assert ("1", "apple", 0, 5) in a and ("1", "apple", 22, 27) in a and len([x for x in a if x[0] == "1"]) == 2
    assert [x for x in a if x[0] == "3"] == [("3", "aa aa", 0, 5), ("3", "aa aa", 3, 8)]
    assert [x for x in a if x[0] == "8"] == []


def test_one_candidate_resolves_several_stay_open(spark):
    d, t = dictionary(spark, DICT), docs(spark, "Apple in York")
    found = detection.detect(t, d)
    assert [r["entity_id"] for r in detection.resolved(found, d).collect()] == ["Y"]
    assert [r["candidate_ids"] for r in detection.unresolved(found, d).collect()] == [["A1", "A2"]]


def brute_snippet(text, s, e, w):
    a, b = max(0, s - w), min(len(text), e + w)
    if a > 0 and a <= (k := text.find(" ", a)) < s:
        a = k + 1
    if b < len(text) and (k := text.rfind(" ", e, b)) != -1:
        b = k
    return ("..." if a > 0 else "") + text[a:b] + ("..." if b < len(text) else "")


def test_snippets_against_brute_force(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away"
    spans = [(i, j) for i in range(0, 50, 3) for j in (i + 1, i + 5)]
    df = spark.createDataFrame([(text, i, j) for i, j in spans], "t string, s int, e int")
    got = [r[0] for r in df.select(c.snippet(F.col("t"), F.col("s"), F.col("e"), 8)).collect()]
    assert got == [brute_snippet(text, i, j, 8) for i, j in spans]


def test_research_headings(spark):
    t = docs(spark, "cover\n# One #\na\n\nTwo\n---\nb\n### Empty\n## Three\nc", "no heading\nat all", " \n ", "---\nx")
    assert rows(segments.research(t)) == [("0", 0, "One", "a"), ("0", 1, "Two", "b"), ("0", 2, "Three", "c"), ("1", 0, None, "no heading\nat all"), ("3", 0, None, "---\nx")]


def test_filing_items(spark):
    t = docs(spark, "x\nItem 1a. Risks\nrefer to Item 2 here\nITEM 7B\nmore\nItem 9. " + "y" * 220)
    assert rows(segments.filings(t)) == [("0", 0, "Item 1A. Risks", "refer to Item 2 here"), ("0", 1, "Item 7B", "more\nItem 9. " + "y" * 220)]


def test_transcript_speakers_and_divider(spark):
    t = docs(spark, "intro\nJane Doe - CEO: hello\nmore\nQ&A\nlost\nOperator: next\nNobody:")
    assert rows(segments.transcripts(t)) == [("0", 0, "Jane Doe - CEO", "hello\nmore"), ("0", 1, "Q&A", ""), ("0", 2, "Operator", "next")]


def brute_pieces(text, most):
    paras, buf = [], []
    for line in text.splitlines() + [""]:
        if line.strip():
            buf.append(line)
        elif buf:
            paras.append("\n".join(buf))
            buf = []
    out, now, n = [], [], 0
    for p in paras:
        k = len(p.split())
        if now and n + k > most:
            out.append("\n\n".join(now))
            now, n = [], 0
        now.append(p)
        n += k
    return out + (["\n\n".join(now)] if now else [])


def test_sub_chunks_against_brute_force(spark):
    texts = ["a b c\n\nd e\n\n\nf g h i j k l\n\nm", "one two three four five six", "", "a\nb\n \nc", "x y\n\nz w\n\nu v"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(segments.sub_chunks(F.col("t"), 4)).collect()]
    assert got == [brute_pieces(t, 4) for t in texts]


def test_overlap_and_truncation(spark):
    df = spark.createDataFrame([(["a b c", "d e", "f"],)], "p array<string>")
    assert df.select(segments.overlapped(F.col("p"), 10, 0.15)).first()[0] == ["a b c", "b c\n\nd e", "d e\n\nf"]
    t = spark.createDataFrame([("aaaa\n\nbbbb\n\ncccc",), ("x" * 50,)], "t string")
    assert [r[0] for r in t.select(segments.truncated(F.col("t"), 3)).collect()] == ["aaaa\n\nbbbb", "x" * 12]


def test_small_expressions(spark):
    df = spark.createDataFrame([("2024-03-05",), ("2024-3",), ("2024",), ("2024-13",), ("2024-03-05T10:00",), (None,)], "t string")
    assert [None if r[0] is None else r[0].strftime("%Y-%m-%d") for r in df.select(c.partial_date(F.col("t"))).collect()] == ["2024-03-05", "2024-03-01", "2024-01-01", None, None, None]
    n = spark.createDataFrame([("aaaa", "aa"), ("a.b", "."), ("x", ""), (None, "a")], "t string, n string")
    assert [r[0] for r in n.select(c.overlapping_count(F.col("t"), F.col("n"))).collect()] == [3, 1, 0, None]


def test_pages(spark):
    html = "<p>out</p><article><p> one <b>two</b></p><p></p><p>three</article><article><p>other</p></article>"
    p = spark.createDataFrame([(1, html), (2, "<p>x</p>"), (3, None)], "k int, html string")
    assert rows(readers.article_texts(p, "k")) == [(1, "one two\n\nthree"), (2, ""), (3, "")]


def test_feeds(spark):
    xml = "<rss><channel><item><title>A</title><link>u1</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item><item><title>no link</title></item></channel></rss>"
    f = spark.createDataFrame([("s", 0, xml), ("t", 1, xml.replace("A<", "B<")), ("u", 2, "broken <")], "source string, feed_order int, xml string")
    items = readers.feed_items(f)
    assert items.count() == 2
    one = readers.first_entries(items).select("title", readers.feed_date(F.col("published_text")).cast("string")).collect()
    assert [tuple(r) for r in one] == [("A", "2024-03-05 10:00:00")]


def test_bindings(spark):
    b = spark.createDataFrame([("http://x/Q1", "Acme", "a firm", "Oz", None, None, "ACM", None), ("http://x/Q2", "Q2", None, None, None, None, None, None)], "item string, itemLabel string, description string, countryLabel string, industryLabel string, exchangeLabel string, ticker string, isin string")
    r = readers.bindings_to_entities(b, "company").collect()
    assert [(x["external_id"], x["description"], x["aliases"]) for x in r] == [("Q1", "Acme is a publicly listed company, headquartered in Oz, trading under ticker ACM. a firm", ["wikidata:Q1", "ticker:ACM"])]


def test_candidates_that_fit(spark):
    chunks = spark.createDataFrame([(1, "bb bb", ["a", "b"]), (2, "x" * 400, ["a"])], "chunk_id int, text string, candidate_ids array<string>")
    e = spark.createDataFrame([("a", "aa", "person", None, "d", []), ("b", "bb", "person", "x", "d", ["bbb"])], "entity_id string, canonical_name string, entity_type string, subtype string, description string, aliases array<string>")
    assert rows(budget.fitted(chunks, e, 200)) == [(1, "a", 1), (1, "b", 2), (2, "a", 1)]
    assert rows(budget.fitted(chunks, e, 35)) == [(1, "b", 1)]
    assert "[1] entity_id=b" in budget.context_block(budget.fitted(chunks, e, 35), e).first()["block"]


def test_candidates_of_all_documents(spark, tmp_path):
    import re

    from lorekeel.plans import catalogue

    e = [(f"e{i}", f"Name{i} Corp", "organization", None, "d" * 40 * i) for i in range(12)] + [("x", "name1 corp", "person", "s", None)]
    a = [("e2", "Deux"), ("e3", "deux"), ("gone", "Nowhere"), ("e4", None)]
    text = lambda *k: " and ".join(f"Name{i} Corp" for i in k)
    docs = [(1, text(1, 2), "news"), (2, "deux. " + text(*range(12)) + " deux", "research"), (3, "xname5 corp", "filing"), (4, "name5 corp, name5 corps " * 3, "transcript"), (5, None, "news"), (6, text(7) * 400, "filing")]
    for name, r, schema in (("entities", e, "entity_id string, canonical_name string, entity_type string, subtype string, description string"), ("entity_aliases", a, "entity_id string, alias string"), ("documents", docs, "doc_id long, text string, doc_type string")):
        spark.createDataFrame(r, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    forms = {i: {n.lower()} | {x.lower() for k, x in a if k == i and x} for i, n, *_ in e}
    count = lambda low, f: len(re.findall(f"(?={re.escape(f)})", low))
    want = [(d, i, sum(count(t.lower(), f) for f in fs)) for d, t, _ in docs if t for i, fs in forms.items() if any(re.search(rf"(?<![^\W_]){re.escape(f)}(?![^\W_])", t.lower()) for f in fs)]
    q = catalogue.queries()
    assert rows(q["alias_match_counts_all"](spark, str(tmp_path))) == rows(spark.createDataFrame(want, "a long, b string, c long"))
    fit = rows(q["fit_candidates_all"](spark, str(tmp_path)))
    shown = {d for d, *_ in fit}
    assert {x[:2] for x in fit} <= {x[:2] for x in want} and shown == {1, 2, 4}  # the sixth fills the budget by itself
    assert {i for d, i, _ in fit if d == 1} == {"e1", "e2", "x"} and 1 < sum(d == 2 for d, *_ in fit) < 13
    assert {d for d, _ in rows(q["kg_context_block_all"](spark, str(tmp_path)))} == shown


def test_texts_of_every_kind_are_cut(spark, tmp_path):
    from lorekeel.plans import catalogue

    docs = [(i, "\n\n".join(f"{kind} {k} " + "word " * 25 for k in range(6)), kind) for i, kind in enumerate(("news", "research", "transcript", "filing", "other"))]
    spark.createDataFrame(docs, "doc_id long, text string, doc_type string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.queries()["sub_chunk_paragraphs"](spark, str(tmp_path)).collect()
    for i, text, _ in docs:
        own = [r["text"] for r in sorted(got, key=lambda r: r["chunk_index"]) if r["document_id"] == str(i)]
        assert len(own) > 1 and all(len(x.split()) <= 60 for x in own) and " ".join(own).split() == text.split()
