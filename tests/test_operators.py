"""Hand-made cases for operators that SQL can't express, and for edge cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import blocks, html, maps, text
from graphloom.operators import chat, chunks, graph, listings, search, statechart, upserts
from graphloom.sources import records
from graphloom.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_searchable_text():
    body = json.dumps([{"id": "1", "type": "paragraph", "content": [{"type": "text", "text": "Hello"}], "props": {"url": "data:image/png;base64,AAAA", "caption": "A cat"}, "children": []}])
    assert blocks.searchable(body) == "Hello text A cat paragraph"
    assert blocks.searchable("{not json") == "{not json"
    assert blocks.searchable('{"id": "x", "url": "y"}') == '{"id": "x", "url": "y"}'
    assert blocks.searchable("") == "" and blocks.searchable(None) is None
    assert blocks.plain(json.dumps({"title": "t", "blocks": [{"b": " one ", "a": "two\nthree"}]})) == "one two three"


def test_secrets():
    assert blocks.has_secret('{"a": [{"myApiKey": "x"}]}') and blocks.has_secret('{"token": "t"}')
    assert not blocks.has_secret('{"apiToken": {"secret": "x"}}') and not blocks.has_secret('{"secret": ""}') and not blocks.has_secret(None)


def test_flatten_blocks(spark):
    body = json.dumps({"blocks": [{"id": "a", "type": "heading", "props": {"level": 2}, "content": ["T", {"text": "u"}, {"text": 3}], "children": [{"id": 7, "type": "image", "props": {"url": "u", "caption": ["c"]}}]}, "junk"]})
    deep = "[" + '{"children": [' * 3000 + "]}" * 3000 + "]"
    rows = blocks.flatten_blocks(spark.createDataFrame([(1, body), (2, "broken"), (3, None), (4, deep), (5, '[{"type": "x", "props": {"level": "2"}}]')], "doc_id long, body string")).collect()
    got = [(r.doc_id, r.pos, r.path, r.parent, r.depth, r.wrapped, r.block_id, r.type, r.level, r.text, r.url, r.caption) for r in rows if r.doc_id != 4]
    assert got == [(1, 0, "000000", "", 0, True, "a", "heading", 2, "Tu", None, None), (1, 1, "000000.000000", "000000", 1, True, None, "image", None, "", "u", None), (5, 0, "000000", "", 0, False, None, "x", 2, "", None, None)]
    assert [blocks._level(x) for x in (None, 0, 1, 2, 2.5, 9, "2", "x", True, "")] == [None, 1, 1, 2, 3, 3, 2, 3, 1, 1]


def test_markdown_chunks(spark):
    body = "# Title\r\n\nfirst  line\nsecond\n\n- item\n2. num\n3) prose\n![a](b)\n| a | b |\n|---|:--:|\n| c |\n||\n#### deep\n#\n-\n| not | a table |\n ![x](y)\n| h |\n--- | ---\n| r |\n![](z)"
    df = spark.createDataFrame([(1, body), (2, None), (3, " \n")], "doc_id long, text string")
    rows = chunks.markdown_chunks(df).orderBy("doc_id", "pos").collect()
    assert [(r.kind, r.level, r.text) for r in rows] == [
        ("heading", 1, "Title"), ("paragraph", None, "first line second"), ("bulletListItem", None, "item"), ("numberedListItem", None, "num"), ("paragraph", None, "3) prose"), ("image", None, "a"),
        ("table", None, "a\tb\nc\n"), ("heading", 3, "deep"), ("paragraph", None, "# - | not | a table | ![x](y)"), ("table", None, "h\nr"), ("image", None, "image"),
    ]
    assert rows[6].rows == [["a", "b"], ["c"], [""]] and rows[5].url == "b" and rows[10].url == "z"
    got = chunks.markdown_chunks(df)
    assert [r.section for r in chunks.section_of(got).orderBy("pos").collect()] == ["Title"] * 7 + ["deep"] * 4
    assert [r.empty for r in chunks.is_empty_body(got).collect()] == [False]
    assert chunks.image_context(got).orderBy("pos").first().context == ""


def test_body_emptiness(spark):
    rows = [(1, "heading", "x"), (2, "checkListItem", "x"), (3, "paragraph", " \n"), (4, "table", ""), (5, "codeBlock", "x"), (6, None, "x")]
    got = {r.doc_id: r.empty for r in chunks.is_empty_body(spark.createDataFrame(rows, "doc_id long, kind string, text string")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}


def test_text_functions(spark):
    assert one(spark, text.claim_before(F.lit("First one. The second claim [00000000-0000-0000-0000-000000000000]"), F.lit(29))) == "The second claim"
    assert one(spark, text.extract_citations(F.lit("[ABCDEF00-0000-0000-0000-000000000000] x [abcdef00-0000-0000-0000-000000000000]"))) == ["abcdef00-0000-0000-0000-000000000000"]
    assert one(spark, text.data_url(F.lit("http://x"))) is None
    assert tuple(one(spark, text.data_url(F.lit("data:image/png;base64,QQ==")))) == ("image/png", "QQ==")
    head = "data:application/octet-stream;base64,"
    for payload, mime in (("PHN2Z", "svg+xml"), ("PD94b", "svg+xml"), ("R0lGO", "gif"), ("/9j/", "jpeg"), ("UklGR", "webp"), ("zzz", "png")):
        assert one(spark, text.repair_mime(F.lit(head + payload))) == f"data:image/{mime};base64,{payload}"
    assert one(spark, text.pad_rows(F.from_json(F.lit('[["a"],["b","c"]]'), "array<array<string>>"))) == [["a", ""], ["b", "c"]]
    assert one(spark, text.humanize(F.lit("saveAsDialog_openURL"))) == "Save As Dialog Open URL"
    assert one(spark, text.parse_metadata(F.lit('{"summary": " ", "keyPoints": []}'))) is None
    assert one(spark, text.match_string(F.lit(' red "fo"x  "" '))) == '"red"* "fox"*'
    assert one(spark, text.section_context(F.lit(None), F.lit(""), F.lit(None))) == ""


def test_vocabularies(spark):
    types = {"a.PDF": "pdf", "b.ppt": "slides", "c.doc": "docx", "d.csv": "spreadsheet", "e.msg": "email", "f.eml": "note", "g.svg": "image", "h.ps1": "code", "i.htm": "code", "j.md": "note", "noext": "note", "k.tar.json": "code"}
    assert {n: one(spark, maps.node_type_of(F.lit(n))) for n in types} == types
    assert [one(spark, maps.bucket_of(F.lit(t))) for t in ("note", "docx", "pdf", "url", "project")] == ["paragraphs", "documents", "pdfs", "links", None]
    assert [one(spark, maps.mime_of(F.lit(e))) for e in (".PNG", "msg", "csv", "json", "")] == ["image/png", "application/vnd.ms-outlook", "", "", ""]
    alts = {"A screenshot of x": None, "an icon": None, "A  Photo": None, "A photograph": "A photograph", "x Description automatically generated.": None, "AI-generated content may be incorrect": None, "AI generated content may be incorrect.": None, "Ask: AI generated content may be incorrect": "Ask: AI generated content may be incorrect", " \n": None, " cat ": "cat"}
    assert {a: one(spark, text.clean_alt(F.lit(a), F.lit(3))) for a in alts} == {a: w or "image-3" for a, w in alts.items()}
    front = ["Table  of Contents", "TOC", "Cover", "cover page", "Title", "Copyright", "Preface", "Foreword", "Acknowledgements", "acknowledgment", "Acronym", "Document Control", "List of Acronyms", " index\n"]
    assert all(one(spark, text.is_front_matter(F.lit(h))) for h in front)
    assert not any(one(spark, text.is_front_matter(F.lit(h))) for h in ("Appendix A", "Change log", "Version history", "Index of terms", ""))


def test_image_tokens(spark):
    a, b = "![alt](kb://image/0123ABCD/k-1)", "kb://image/0123abcd/k-1"
    assert one(spark, text.image_refs(F.lit(f"x {a} {b} kb://image/short/k kb://image/01234567/k.2]"))) == ["0123abcd/k-1", "01234567/k.2"]
    # only the first writing of a token is taken out
    assert one(spark, text.strip_image_refs(F.lit(f"x{a}\n\n\n\n{b} y{a}"))) == f"x\n\n{b} y"
    assert one(spark, text.image_refs(F.lit("other://image/01234567/k"), "other")) == ["01234567/k"]


@pytest.mark.parametrize("body", ["", "a", "é" * 40, "a€" * 30, "😀" * 20, "x" * 100, "aé€😀" * 12])
def test_cuts_in_bytes(spark, body):
    data = body.encode()
    for limit in (0, 1, 2, 3, 5, 50, 101):
        assert one(spark, text.cut_utf8(F.lit(body), F.lit(limit))) == data[:limit].decode("utf-8", "ignore")
    for offset, length in ((0, 7), (1, 7), (2, 3), (3, 1), (5, 0), (200, 5), (0, 500), (1, 500), (0, None)):
        got = one(spark, text.body_window(F.lit(body), offset, length))
        # both ends move inwards to the nearest characters
        start, end = min(offset, len(data)), min(min(offset, len(data)) + (8192 if length is None else length), len(data))
        inside = lambda i: 0 < i < len(data) and 128 <= data[i] < 192
        while end > start and inside(end):
            end -= 1
        while start < end and inside(start):
            start += 1
        cut = offset > 0 or len(data) > (8192 if length is None else length)
        want = (data[start:end].decode(), True, start, end - start, len(data)) if cut else (body, False, 0, len(data), len(data))
        assert tuple(got) == want
    assert one(spark, text.body_window(F.lit(body), 3, 2, True)).body == body
    assert one(spark, text.embed_input(F.lit("é"), F.lit(body), 10)) == "é\n\n" + (data[:6].decode("utf-8", "ignore") if body.strip() else "")
    assert one(spark, text.embed_input(F.lit(" "), F.lit(body), 10)) == (data[:10].decode("utf-8", "ignore") if body.strip() else "")


def test_split_label(spark):
    cases = {
        "ESC / CLOSE [dirty] [ again ]": (["ESC", "CLOSE"], ["dirty", "again"]), "user waits": (["user waits"], []), "then wait  SAVE": (["then wait", "SAVE"], []), "SAVE / shows it": (["SAVE"], []),
        "Save it / F10": (["Save it", "F10"], []), "Set / OPEN now / Open it": (["Set", "OPEN now"], []), "": ([], []), "[only]": ([], ["only"]), "[]": (["[]"], []),
    }
    assert {k: tuple(one(spark, text.split_label(F.lit(k)))) for k in cases} == cases


CHART = """```mermaid
stateDiagram-v2
[*] --> Home
Home --> Dialog : OPEN [ready]
note right of Home
  Ghost --> Nowhere : BAD
end note
state Group {
  Dialog --> Home : Esc
  Dialog --> Dialog : RETRY
}
Dialog --> [*]
Home --> my-page.saved
Home --> Exit2 : ESCALATE / CLOSED
[*] --> Dialog
```"""


def test_statechart(spark):
    t = statechart.import_transitions(spark.createDataFrame([("c", CHART.replace("\n", "\r\n")), ("none", None), ("empty", "")], "doc_id string, text string"))
    assert t.count() == 8 and t.where("is_start").count() == 2 and t.where("is_end").count() == 1
    e, s = statechart.edges_of(t), statechart.states_of(t)
    assert [(r.source, r.target, r.kind, r.label) for r in e.orderBy("pos").collect()] == [
        ("__start__", "Dialog", "forward", "start"), ("__start__", "Home", "forward", "start"), ("Home", "Dialog", "forward", "OPEN"), ("Dialog", "Home", "back", "Esc"),
        ("Dialog", "Dialog", "self", "RETRY"), ("Home", "my-page.saved", "forward", "My Page.saved"), ("Home", "Exit2", "forward", "ESCALATE / CLOSED"),
    ]
    assert [(r.name, r.role) for r in s.orderBy("pos").collect()] == [("__start__", "start"), ("Home", "screen"), ("Dialog", "screen"), ("my-page.saved", "success"), ("Exit2", "cancel")]
    assert {r.name: r["rank"] for r in statechart.layer_rank(s, e).collect()} == {"__start__": 0, "Dialog": 1, "Home": 2, "my-page.saved": 3, "Exit2": 3}
    lines = statechart.export_transitions(s, e).first().text.split("\n")
    assert lines[:3] == ["stateDiagram-v2", "  [*] --> __start__", "  __start__ --> Dialog : START"] and lines[4] == "  Home --> Dialog : OPEN [ready]" and len(lines) == 9
    again = statechart.edges_of(statechart.import_transitions(statechart.export_transitions(s, e)))
    key = lambda df: {(r.source, r.target, tuple(r.events), tuple(r.guards)) for r in df.collect() if r.source != "__start__"}
    assert key(again) == key(e)
    feature = statechart.feature_text(s, e, spark.createDataFrame([("c", "Pages")], "doc_id string, title string")).first().text
    assert feature.startswith("### Feature: Pages\n\n**Background:**\n**Given** the flow is launched\n\n#### 1. Home\n\n**Scenario**: OPEN\n**Given** on \"Home\"\n**When** OPEN [ready]\n**Then** navigates to \"Dialog\"\n\n**Scenario**: My Page.saved\n")
    assert feature.endswith('#### 2. Dialog\n\n**Scenario**: Esc\n**Given** on "Dialog"\n**When** Esc\n**Then** returns to "Home"\n\n**Scenario**: RETRY\n**Given** on "Dialog"\n**When** RETRY\n**Then** remains on "Dialog"\n')
    assert statechart.integrity(s, e).count() == 0
    assert {(r.rule, r.severity, r.message) for r in statechart.integrity(s.where("name <> 'Exit2'"), e).collect()} == {("D2", "error", 'edge "Home --> Exit2" references missing target node "Exit2"')}
    roles = {"okay": "screen", "is_ok": "success", "doneCancelled": "cancel", "missingFile": "error", "Result": "success", "quit": "cancel", "warnUser": "error"}
    assert {n: one(spark, text.infer_role(F.lit(n))) for n in roles} == roles
    kinds = {"ESCALATE": "forward", "back": "back", "GO BACK": "back", "FEEDBACK": "forward", "Veto it": "back"}
    assert {k: one(spark, text.infer_kind(F.lit("a"), F.lit("b"), F.array(F.lit(k)))) for k in kinds} == kinds


def test_hand_made_chart(spark):
    """Roles, tabs, messages, examples and texts of authors, which imported charts lack."""
    s = spark.createDataFrame([("c", 0, "s", "Start", "start", None), ("c", 1, "a", "Page A", "screen", ["one", "two"]), ("c", 2, "t", "Between", "transient", None)], "doc_id string, pos long, name string, title string, role string, tabs array<string>")
    own = "**Scenario**: by hand\n**Given** x\n**When** y\n\n"
    rows = [
        ("c", 0, "s", "a", ["GO"], ["g1", "g2"], "forward", "go", None, None, None), ("c", 1, "a", "lost", [], None, "self", "Save", ("said\nit", True), (["h1", "h2"], [["1", "2"], ["3", "4"]]), None),
        ("c", 2, "a", "t", ["X"], [], "forward", "", None, None, own), ("c", 3, "t", "a", ["Y"], [], "forward", "y", None, None, None),
    ]
    e = spark.createDataFrame(rows, f"doc_id string, pos long, source string, target string, events array<string>, guards array<string>, kind string, label string, message {statechart.MESSAGE}, examples {statechart.EXAMPLES}, scenario_override string")
    assert [r.scenario for r in statechart.scenarios(s, e).orderBy("pos").collect()] == [
        '**Scenario Outline**: Save\n**Given** on "Page A"\n**When** Save\n**Then** remains on "Page A"\n"""\nsaid\nit\nTODO(verify)\n"""\n**Examples**\n| h1 | h2 |\n| 1 | 2 |\n| 3 | 4 |', own.rstrip("\n"),
    ]
    assert "**Given** [g1] and [g2]\n" in statechart.feature_text(s, e).first().text
    assert {(r.rule, r.severity, r.message) for r in statechart.integrity(s, e).collect()} == {
        ("D2", "error", 'edge "a --> lost" references missing target node "lost"'), ("D2", "warn", 'self edge "a --> lost" has two ends'), ("D4", "error", 'scenario "by hand" missing Given/When/Then'),
    }
    assert statechart.export_transitions(s, e).first().text == "stateDiagram-v2\n  [*] --> s\n  state a {\n    [*] --> one\n    one --> two : PAGE\n    two --> one : PAGE\n  }\n  s --> a : GO [g1] [g2]\n  a --> t : X\n  t --> a : Y"


@pytest.mark.parametrize("seed", range(4))
def test_layer_ranks_are_longest_paths(seed):
    """Without cycles a rank is the longest path to a state, by brute force; with cycles it rises along the edges that are kept."""
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    edges = [tuple(sorted(rnd.sample(names, 2))) for _ in range(14)]
    rnd.shuffle(edges)
    got = dict(zip(names, statechart._ranks(names, {"n3"}, edges)))
    longest = lambda n: max((longest(a) + 1 for a, b in edges if b == n), default=0)
    assert got == {n: longest(n) for n in names}
    cycle = dict(zip("abc", statechart._ranks(list("abc"), set(), [("a", "b"), ("b", "c"), ("c", "a"), ("b", "b")])))
    assert cycle == {"a": 0, "b": 1, "c": 2}


def test_graph_maintenance(spark):
    edges = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("a", "q", "c"), ("c", "p", "x")], "src_id string, predicate string, dst_id string")
    nodes = spark.createDataFrame([("a", "n", "A", "aa"), ("b", "n", "B", "bb"), ("c", "n", "C", "cc")], "id string, type string, title string, body_md string")
    key = lambda df: {tuple(r) for r in df.select("src_id", "predicate", "dst_id").collect()}
    new = spark.createDataFrame([("a", "p", "z"), ("a", "p", "z")], edges.schema)
    once = graph.replace_edges(edges, new)
    assert key(once) == {("a", "p", "z"), ("b", "p", "c"), ("a", "q", "c"), ("c", "p", "x")} and once.count() == 4
    assert key(graph.replace_edges(once, new)) == key(once)
    gone = spark.createDataFrame([("c",)], "id string")
    assert key(graph.remove_cascade(nodes, edges, gone)[1]) == {("a", "p", "b")}
    assert {r.issue for r in graph.dangling_edges(edges, nodes).collect()} == {"missing-target"}
    got = {(r.id, r.hop, r.predicate) for r in graph.expand(edges, nodes, spark.createDataFrame([("a",)], "seed string")).collect()}
    assert got == {("b", 1, "p"), ("c", 1, "q")}
    assert graph.expand(edges, nodes, spark.createDataFrame([], "seed string")).count() == 0


def brute_expand(edges, nodes, seed, depth, limit):
    """Breadth first with the smallest predicate to each node, among nodes that exist."""
    around = {}
    for a, p, b in edges:
        around.setdefault(a, []).append((p, b))
        around.setdefault(b, []).append((p, a))
    seen, front, out = {seed}, {seed}, []
    for hop in range(1, depth + 1):
        met = {}
        for n in front:
            for p, o in around.get(n, []):
                if o not in seen:
                    met[o] = min(p, met.get(o, p))
        seen |= set(met)
        front = set(met)
        out += [(hop, p, o) for o, p in met.items()]
    return {(o, h, p) for h, p, o in sorted(x for x in out if x[2] in nodes)[:limit]}


@pytest.mark.parametrize("seed", [1, 2])
def test_expand_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i:03}" for i in range(80)]
    hubs = ["n000", "gone", "n001"]
    edges = list({(rnd.choice(names), rnd.choice("pq"), rnd.choice(names + hubs * 30)) for _ in range(260)} | {("n005", "p", "n005")})
    nodes = spark.createDataFrame([(n, "t", n, "b") for n in names if n != "n007"], "id string, type string, title string, body_md string")
    df = spark.createDataFrame(edges, "src_id string, predicate string, dst_id string")
    seeds = spark.createDataFrame([(n,) for n in names] + [("n001",), (None,)], "seed string")
    known = set(names) - {"n007"}
    for depth, limit in ((1, 4), (2, 4), (2, 50), (7, 0)):
        got = {}
        for r in graph.expand(df, nodes, seeds, depth, limit).collect():
            got.setdefault(r.seed, set()).add((r.id, r.hop, r.predicate))
        want = {n: brute_expand(edges, known, n, max(1, min(2, depth)), max(1, limit)) for n in names}
        assert got == {n: w for n, w in want.items() if w}


def test_expand_through_a_hub_is_bounded(spark):
    """A hub of 100,000 members: the second hop has at most twice the limit of rows for each edge of a seed."""
    n = 100_000
    name = lambda c: F.format_string("m%07d", c)
    edges = spark.range(n).select(name(F.col("id")).alias("src_id"), F.lit("contains").alias("predicate"), F.lit("hub").alias("dst_id"))
    nodes = spark.range(n).select(name(F.col("id")).alias("id"), F.lit("note").alias("type"), F.lit("t").alias("title"), F.lit("b").alias("body_md"))
    seeds = spark.range(0, n, 500).select(name(F.col("id")).alias("seed"))
    found = graph.expand(edges, nodes, seeds, 2, 50)
    assert found.count() == 200 * 50
    assert {r.id for r in found.where("seed = 'm0000000'").collect()} == {f"m{i:07}" for i in range(1, 51)}

    def rows(plan):
        own = [int(plan.metrics().apply("numOutputRows").value())] if plan.metrics().contains("numOutputRows") else []
        return own + [x for i in range(plan.children().size()) for x in rows(plan.children().apply(i))]

    plan = found._jdf.queryExecution().executedPlan()
    assert max(rows(plan), default=0) <= 2 * n


def brute_bm25(nodes, query):
    import math
    import re

    words = {i: re.findall(r"[^\W_]+", f"{t or ''} {b or ''}".lower()) for i, t, b in nodes}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    asked = {w for w in (x.replace('"', "").lower() for x in query.split()) if w}
    out = {}
    for i, own in words.items():
        tf = {p: sum(w.startswith(p) for w in own) for p in asked}
        if asked and all(tf.values()):
            df = {p: sum(any(w.startswith(p) for w in o) for o in words.values()) for p in asked}
            out[i] = sum(max(math.log((n - df[p] + 0.5) / (df[p] + 0.5)), 1e-6) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(own) / avg)) for p, x in tf.items())
    return out


@pytest.mark.parametrize("named", [64, 1])
def test_search_matches_brute_force(spark, tmp_path, monkeypatch, named):
    """With prefixes named in the plan and without, from a stored index and from none."""
    monkeypatch.setattr(search, "NAMED", named)
    rnd = random.Random(3)
    words = ["fox", "foxes", "fo", "red", "reading", "the", "a", "é", "don't", "zebra"]
    rows = [(f"n{i:02}", rnd.choice([None, "", "Red fox"]), " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for i in range(60)]
    nodes = spark.createDataFrame(rows, "id string, title string, body_md string")
    asked = ["fox", 'the "fo', "", "red red the a", "zebra é", "nowhere fox", "FO re"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    want = {(q, i, round(x, 6)) for q, text_ in enumerate(asked) for i, x in brute_bm25(rows, text_).items()}
    key = lambda df: {(r.query_id, r.id, round(r.score, 6)) for r in df.collect()}
    assert key(search.search_text(nodes, queries)) == want
    index = search.store_index(nodes, str(tmp_path / "index"))
    assert key(search.search_index(index, queries)) == want
    for q, text_ in enumerate(asked):
        best = sorted((-round(x, 9), i) for i, x in brute_bm25(rows, text_).items())[:3]
        assert {i for p, i, _ in key(search.search_index(index, queries, 3)) if p == q} == {i for _, i in best}
    assert search.search_index(index, queries.where("query_id = 2")).count() == 0
    one_ = search.search_index(index, queries.where("query_id = 0"))
    assert named == 1 or "StartsWith(term" in one_._jdf.queryExecution().executedPlan().toString()


def test_highlight(spark):
    assert one(spark, search.highlight(F.lit("The cat, then other"), ["the"])) == "<mark>The</mark> cat, <mark>then</mark> other"
    # terms are words, not patterns
    assert one(spark, search.highlight(F.lit("a.b axb"), ["a.b"])) == "<mark>a.b</mark> axb"
    assert one(spark, search.highlight(F.lit("x"), [])) == "x"
    words = [f"w{i}" for i in range(100)]
    words[10], words[60], words[64] = "fox", "fox", "red"
    cut = lambda size, terms: one(spark, search.highlight_window(F.lit("¡" + " ".join(words) + "!"), terms, size))
    # the window with both terms wins, and lies around them
    assert cut(9, ["fox", "red"]) == " … w58 w59 <mark>fox</mark> w61 w62 w63 <mark>red</mark> w65 w66 … "
    assert cut(3, ["fox"]) == " … w9 <mark>fox</mark> w11 … "
    assert cut(2, ["none"]) == "¡w0 w1 … "
    assert cut(500, ["w99"]).endswith("w98 <mark>w99</mark>!") and cut(2, ["w99"]) == " … w98 <mark>w99</mark>!"
    assert one(spark, search.highlight_window(F.lit(""), ["a"])) == "" and one(spark, search.highlight_window(F.lit(None).cast("string"), ["a"])) is None


def test_passages(spark):
    blocks_ = spark.createDataFrame([(1, 0, "Intro words"), (1, 1, "Cats chase mice at night"), (1, 2, "Dogs sleep"), (1, 3, " "), (2, 0, "alpha beta gamma delta " + "filler " * 50), (2, 1, "alpha beta more"), (2, 2, "ab")], "doc_id long, pos int, text string")
    long_ = "ice at night and then a very different ending that no block holds"
    claims = [(1, 1, "cats CHASE  mice"), (2, 1, "mice that cats hunt"), (3, 1, "zebra"), (4, 1, "ats chase mi"), (5, 1, "ch"), (6, 2, "beta or alpha"), (7, 2, "B"), (8, 1, long_), (9, 1, "")]
    got = {r.claim_id: (r.pos, r.stage) for r in search.passages(blocks_, spark.createDataFrame(claims, "claim_id long, doc_id long, claim string")).collect()}
    # 6: both blocks hold both words; the shorter block is the denser one
    assert got == {1: (1, 1), 2: (1, 4), 4: (1, 1), 5: (1, 1), 6: (1, 4), 7: (0, 1)}
    prefix = "Dogs sleep beside the warm fireplace when"
    more = spark.createDataFrame([(1, 0, "x"), (1, 1, prefix + " rain falls")], "doc_id long, pos int, text string")
    assert [(r.pos, r.stage) for r in search.passages(more, spark.createDataFrame([(1, 1, prefix + " it snows in the far and cold north")], "claim_id long, doc_id long, claim string")).collect()] == [(1, 3)]


def test_type_filter_keeps_weights(spark, tmp_path):
    """A filtered hybrid search weighs terms over all nodes, and drops other types."""
    rows = [(f"n{i}", "note" if i % 2 else "pdf", "fox" if i % 3 else "hen", "fox fox" if i < 4 else "hen") for i in range(12)]
    nodes = spark.createDataFrame(rows, "id string, type string, title string, body_md string").withColumn("jsonld", F.lit("{}"))
    vectors = nodes.select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    texts, asked = spark.createDataFrame([(1, "fox")], "query_id long, query string"), spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    index = search.index_of(nodes)
    hits = search.hybrid(index, nodes, vectors, texts, asked, 2, "note").collect()
    every = {r.id: r.score for r in search.search_index(index, texts).collect()}
    note = {i: s for i, s in every.items() if int(i[1:]) % 2}
    assert {r.id for r in hits} <= {f"n{i}" for i in range(1, 12, 2)} and max(hits, key=lambda r: r.score).id == min(note, key=lambda i: (-note[i], i))
    found = search.search_nodes(search.hybrid(index, nodes, vectors, texts, asked, 3), nodes).collect()
    assert len(found) == 3 and all(list(r.provenance) == [x.id for x in sorted(found, key=lambda x: (-x.score, x.id))] for r in found)


def test_upserts(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, updated_at int, v string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 0, "old"), ("c", 1, "z")], base.schema)
    got = upserts.upsert(base, new)
    want = {("a", "new"), ("b", "y"), ("c", "z")}
    assert {(r.id, r.v) for r in got.collect()} == want
    assert {(r.id, r.v) for r in upserts.upsert(got, new).collect()} == want
    vec = spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<float>")
    new = spark.createDataFrame([("a", None), ("b", [3.0, 4.0])], vec.schema)
    assert {r.id: r.embedding for r in upserts.upsert_vectors(vec, new, 2).collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.0]}
    with pytest.raises(Exception, match="dimensions"):
        upserts.upsert_vectors(vec, spark.createDataFrame([("a", [1.0])], vec.schema), 2).collect()


def test_chat(spark):
    cite = "[00000000-0000-0000-0000-000000000000]"
    said = ["q1", f"a1 {cite} ", "", f"a2 {cite}", "q3"]
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string")
    prompts = {r.turn: r.prompt for r in chat.build_prompts(turns, closing="Answer.").collect()}
    assert prompts[0] == "Current question:\nq1\n\nAnswer." and prompts[4] == "Prior conversation:\nUser: q1\n\nAssistant: a1\n\nAssistant: a2\n\nCurrent question:\nq3\n\nAnswer."
    block = turns.select("conv_id").distinct().select("conv_id", text.section_context(F.lit("Head"), F.lit(""), F.lit("terse")).alias("section"))
    assert chat.build_prompts(turns, block, "A.").orderBy("turn").first().prompt == "Current section context:\n- Heading: Head\n- Style: terse\nWrite content that fits the purpose and follows the style. Do not repeat the heading.\n\nCurrent question:\nq1\n\nA."
    failed = turns.withColumn("error", F.when(F.col("turn") == 1, "timeout"))
    assert [t["text"] for t in chat.prior_turns(failed).where("turn = 4").first().context] == ["q1", "a2"]
    assert [t["text"] for t in chat.prior_turns(turns, 2, include_current=True).where("turn = 4").first().context] == ["a2", "q3"]
    assert [r.turn for r in chat.trim_history(turns, 5).orderBy("turn").collect()] == [4]
    texts = turns.select(F.col("turn").alias("doc_id"), "text")
    assert [r.used for r in chat.gate_citations(texts, spark.createDataFrame([("x",)], "id string")).collect()] == [False, False]
    assert [r.used for r in chat.gate_citations(texts, spark.createDataFrame([("x",)], "id string"), tools=True).collect()] == [True, True]
    calls = spark.createDataFrame([(1, "cite", True, None, None, 2, 9, "secret")], "call_id int, command_id string, has_selection boolean, has_arg boolean, replace_selection boolean, n_citations int, duration_ms int, prompt string")
    row = chat.redact_audit(calls).first()
    assert row.kind == "slash.cite" and json.loads(row.body) == {"commandId": "cite", "hasSelection": True, "hasArg": False, "replaceSelection": False, "citationCount": 2, "durationMs": 9}


def test_promotion_and_moves(spark):
    meta = lambda **k: json.dumps({"name": "n", **k})
    rows = [("a", "note", "A", "x", meta(projectId="p", collectionId="c1", referenceIds=["r"]), "draft", 1), ("b", "note", "B", "y", meta(collectionId="c1", odd='{"1"}'), "canonical", 1), ("r", "pdf", "R", "z", meta(), "draft", 1)]
    nodes = spark.createDataFrame(rows, "id string, type string, title string, body_md string, jsonld string, kind string, day int").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("collection_id", F.get_json_object("jsonld", "$.collectionId"))
    stale = graph.derive_edges(nodes).unionByName(spark.createDataFrame([("a", "contains", "old"), ("gone", "style-guides", "a"), ("q", "style-guides", "r"), ("b", "cites", "a")], "src_id string, predicate string, dst_id string"))
    key = lambda df: {tuple(r) for r in df.select("src_id", "predicate", "dst_id").collect()}
    done = upserts.promote(nodes, spark.createDataFrame([("a",), ("a",), ("b",), ("none",)], "id string"), "2025-01-01", stale)
    got = {r.id: r for r in done.nodes.collect()}
    assert len(got) == 3 and {i: r.kind for i, r in got.items()} == {"a": "canonical", "b": "canonical", "r": "draft"} and got["a"].policy_decision_id and got["b"].policy_decision_id is None
    assert got["a"].jsonld == rows[0][4] and got["a"].body_md == "x" and str(got["a"].updated_at).startswith("2025") and str(got["b"].updated_at).startswith("2024")
    assert key(done.edges) == {("a", "contains", "p"), ("a", "contains", "c1"), ("r", "style-guides", "a"), ("b", "contains", "c1"), ("q", "style-guides", "r"), ("b", "cites", "a")}
    (line,) = done.audit.collect()
    assert line.kind == "workspace.promoteDraft" and json.loads(line.body)["draftId"] == "a" and json.loads(line.body)["decisionId"] == got["a"].policy_decision_id
    moved = upserts.reassign(nodes, spark.createDataFrame([("a", "c2"), ("b", None)], "id string, collection_id string"))
    after = {r.id: (r.collection_id, json.loads(r.jsonld)) for r in moved.collect()}
    assert after["a"] == ("c2", {"name": "n", "projectId": "p", "collectionId": "c2", "referenceIds": ["r"]}) and after["b"] == (None, {"name": "n", "collectionId": None, "odd": '{"1"}'}) and after["r"] == (None, {"name": "n"})
    assert key(upserts.reassign_edges(graph.derive_edges(nodes), moved.where("id in ('a', 'b')"))) == {("a", "contains", "p"), ("a", "contains", "c2"), ("r", "style-guides", "a")}
    mirror = listings.markdown_mirror(done.nodes.where("id = 'a'").withColumn("title", F.lit("A\nB")).withColumn("body_md", F.lit("\n x \n"))).first().text
    assert mirror == f"---\nid: a\ntype: note\ntitle: A B\nupdatedAtUtc: 2025-01-01T00:00:00Z\npolicyDecisionId: {got['a'].policy_decision_id}\n---\n\n# A B\n\nx\n"


def test_record_files(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))

    put("a.json", {"id": "a", "draft": {"type": "note", "title": "T", "jsonld": '{"piId":"X"}'}, "updatedAtUtc": "2024-01-01T00:00:00Z"})
    put("b.json", {"id": "b", "draft": {"title": "U", "jsonld": "", "piId": "Y"}})
    put("c.json", {"draft": {"type": "note"}})
    put("d.json", "{broken")
    rows = {r.id: r for r in records.read_records(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].pi_id == "X" and rows["b"].pi_id == "Y"
    assert rows["b"].type == "draft" and rows["b"].updated_at_utc.startswith("1970") and json.loads(rows["b"].jsonld)["title"] == "U"
    assert {r.id for r in records.read_records(spark, str(tmp_path), "canonical").collect()} == {"a"}


def test_sinks(spark, tmp_path):
    row = lambda i, t, at, title: (i, (t, title, "b", None, None), at, "me", "canonical", None)
    put = lambda *r: records.write_canonical(spark.createDataFrame(list(r), records.RECORD), str(tmp_path / "kb"))
    put(row("1", "note", "2024-01-01", "old"), row("1", "note", "2024-01-02", "new"), row("2", "pdf", "2024-01-01", "two"), row(None, "pdf", "2024", "lost"), row("9", "", "2024", "no type"))
    put(row("3", "pdf", "2024-01-01", "three"), row("2", "pdf", "2023-01-01", "late"))
    assert sorted(p.name for p in (tmp_path / "kb").iterdir()) == ["notes", "pdfs"]
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "kb").rglob("*.json")}
    held = lambda: sorted((r.id, r.type, r.title) for r in records.canonical_rows(spark, str(tmp_path / "kb")).collect())
    assert held() == [("1", "note", "new"), ("2", "pdf", "two"), ("3", "pdf", "three")]
    # a batch adds files and leaves the others; an id that changes its type has its latest record only
    before = files()
    put(row("3", "note", "2024-03-01", "moved"))
    assert before.items() < files().items() and len(files()) == len(before) + 1
    want = [("1", "note", "new"), ("2", "pdf", "two"), ("3", "note", "moved")]
    assert held() == want
    records.compact_canonical(spark, str(tmp_path / "kb"))
    assert held() == want and not before.keys() & files().keys()
    assert spark.read.schema(records.RECORD).option("recursiveFileLookup", True).json(str(tmp_path / "kb")).count() == 3
    audit = spark.createDataFrame([("k", "t", "b")], "kind string, timestamp string, body string")
    records.append_audit(audit, str(tmp_path / "audit"))
    records.append_audit(audit, str(tmp_path / "audit"))
    assert [json.loads(r.value)["kind"] for r in spark.read.text(str(tmp_path / "audit")).collect()] == ["k", "k"]


def test_routing(spark, tmp_path):
    files = {
        "a.bin": (b"%PDF-1.7", "pdf"), "b.docx": (b"PK\x03\x04..", "docx"), "c.csv": (b"a,b", "csv"), "d.zzz": (b"\x00\x01\x02", "rejected"), "e.xls": (b"\xd0\xcf\x11\xe0", "legacy-office"), "f.dat": (b"\xd0\xcf\x11\xe0", "rejected"),
        "g.zip": (b"PK\x03\x04", "rejected"), "h.": (b"PK\x03\x04 word/document.xml", "docx"), "i.msg": (b"\xd0\xcf\x11\xe0", "msg"), "j.SVG": (b"<svg/>", "image"), "k.mdown": (b"# x", "md"), "l": (b"plain", "txt"),
        # a NUL after an F0 0A pair, and bytes of which more than three in ten are no printable ASCII
        "m.txt": (b"\xf0\x0a" + b"a" * 50 + b"\x00", "rejected"), "n.txt": ("é".encode() * 2 + b"a" * 9, "rejected"), "o.txt": ("é".encode() + b"a" * 9, "txt"), "q.json": (b"{}", "txt"),
    }
    for name, (data, _) in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.format for r in records.route_files(spark, str(tmp_path)).collect()}
    assert got == {n: f for n, (_, f) in files.items()}
    by_mime = lambda m: one(spark, records.format_of(F.lit("x.bin"), F.lit(b"abc"), F.lit(m)))
    assert [by_mime(m) for m in ("application/pdf", "application/vnd.ms-excel", "IMAGE/x", "text/markdown", "x/y")] == ["pdf", "csv", "image", "md", "txt"]


def test_csv_tables(spark, tmp_path):
    cases = {
        'a,"x ""y""\nz"\nb\n': [["a", 'x "y"\nz'], ["b", ""]], "a,b\r\nc,d,e\r\n,\r\n\r\n": [["a", "b", ""], ["c", "d", "e"]], "": [], "\n\n": [], "a": [["a"]], "a,": [["a", ""]],
        'p"q,r"s,t': [["pq,rs", "t"]], '"open, to\nthe end': [["open, to\nthe end"]], ",\nx": [["", ""], ["x", ""]], '"",""': [],
    }
    assert {t: records.cells_of(t) for t in cases} == cases
    (tmp_path / "c.csv").write_text('a,"x ""y""\nz"\nb\n')
    assert [r.rows for r in records.read_csv_tables(spark, str(tmp_path)).collect()] == [[["a", 'x "y"\nz'], ["b", ""]]]
    assert [list(r) for r in records.read_csv_rows(spark, str(tmp_path / "c.csv")).collect()] == [["a", 'x "y"\nz'], ["b", None]]


def test_stream_forms(spark, tmp_path):
    rows = spark.createDataFrame([("k", "2024-01-01 00:05:00"), ("k", "2024-01-01 00:06:00"), ("m", "2024-01-01 02:00:00")], "key string, t string").select("key", F.to_timestamp("t").alias("ts"), F.col("key").alias("kind"))
    rows.write.parquet(str(tmp_path / "s"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))
    for name, df in (("audit", jobs.audit_counts(stream())), ("tasks", jobs.dedupe_tasks(stream()))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("tasks").count() == 2
    assert {(r.kind, r.n) for r in jobs.audit_counts(rows).collect()} == {("k", 2), ("m", 1)}


def test_block_operators(spark):
    from graphloom.operators import bodies

    marks = lambda t: [(r["text"], "".join(k[0] for k in ("bold", "italic", "strike", "code") if r[k])) for r in bodies.runs_of(t)]
    assert marks("a **b _c_** ~~d~~ `**e**`") == [("a ", ""), ("b ", "b"), ("c", "bi"), (" ", ""), ("d", "s"), (" ", ""), ("**e**", "c")]
    assert marks("**a*b** snake_case_x __u__") == [("*", ""), ("a", "i"), ("b** snake", ""), ("case", "i"), ("x ", ""), ("u", "b")]
    assert marks("") == []
    assert bodies.tables_of("<table><tr><th>a</th><td>b<p>c</p></td></tr><tr><td>d</td></tr></table>") == [[["a", "b\nc"], ["d", ""]]]
    pages = spark.createDataFrame([(1, "<table><tr><td>x</td></tr></table>"), (2, None)], "page_id long, html string")
    assert [(r.page_id, r.rows) for r in bodies.html_tables(pages).collect()] == [(1, [["x"]])]
    head = lambda t, **k: {"type": "heading", "content": t, **k}
    body = [
        head("Contents", children=[head("Inner")]), head("Real", props={"level": 9}, children=[head("Sub", props={"level": 2})]), head("Folded", props={"isToggleable": True}, children=[head("Below")]),
        {"type": "paragraph", "id": "attach-1", "children": [head("File")]}, {"type": "paragraph", "id": "attachments-root", "children": [head("Files")]}, {"type": "paragraph", "content": "p", "children": [head("Appendix A")]}, head(" "),
    ]
    flat = blocks.flatten_blocks(spark.createDataFrame([(1, json.dumps({"blocks": body})), (2, json.dumps(body))], "doc_id long, body string"))
    got = [(r.type, r.level, r.text) for r in bodies.outline(flat).orderBy("pos", "type").collect()]
    assert got == [x for level, t in ((3, "Real"), (2, "Sub"), (1, "Appendix A")) for x in (("heading", level, t), ("paragraph", None, ""))]
    assert [(r.doc_id, r.text) for r in bodies.source_text(flat).collect()] == [(1, "Contents\n\nReal\n\nFolded\n\np")]
    items = [{"type": t, "props": {"id": f"art-{t}"} if t == "table" else {"id": "x"}, "id": "art-no"} for t in ("paragraph", "checkListItem", "table", "codeBlock", "video")]
    tagged = bodies.tag_artifacts(blocks.flatten_blocks(spark.createDataFrame([(1, json.dumps(items))], "doc_id long, body string"))).orderBy("path").collect()
    assert len(tagged) == 3 and tagged[2].artifact_id == "art-table" and all(r.artifact_id.startswith("art-") and r.artifact_id != "art-no" for r in tagged)
    got, tally = bodies.with_report(flat, F.col("text") != "Real")
    n = got.count()
    assert tally.get == {"indexed": n, "embedded": n - 2}


def test_images_of_nested_blocks(spark):
    from graphloom.operators import bodies

    pic = lambda **k: {"type": "image", "props": {"url": "data:image/png;base64,QQ==", **k}}
    para = lambda t, **k: {"type": "paragraph", "content": t, **k}
    body = [
        {**pic(caption="c"), "id": "i1", "children": [para("own child")]}, para("one", children=[para("nested")]), para(""), para("two"), {"type": "heading", "content": "h"}, para("far"),
        {"type": "heading", "children": [pic(id="i2", contextText=" before ", extractedText="read"), para("not used"), pic(extractedText="  ")]}, para("outside"), {"type": "image", "props": {"url": "http://x"}}, {"type": "image", "props": {"url": "data:;base64,QQ"}},
    ]
    found = bodies.images(blocks.flatten_blocks(spark.createDataFrame([(1, json.dumps(body))], "doc_id long, body string"))).orderBy("idx").collect()
    assert [(r.idx, r.block_id, r.caption, r.mime, r.n_payload, r.context) for r in found] == [
        (0, "i1", "c", "image/png", 4, "one\ntwo"), (1, "i2", None, "image/png", 4, "Context (text immediately before the image):\nbefore\n\nExtracted text from the image (OCR):\nread"), (2, None, None, "image/png", 4, ""),
    ]


def test_porter(spark):
    from graphloom.functions.porter import stem

    pairs = "caresses caress ponies poni cats cat agreed agre plastered plaster motoring motor hopping hop filing file happy happi relational relat conditional condit vietnamization vietnam operator oper triplicate triplic hopefulness hope revival reviv adjustment adjust adoption adopt rate rate controll control sky sky été été".split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]
    nodes = spark.createDataFrame([("1", "Motoring", "cats"), ("2", None, "a motor")], "id string, title string, body_md string")
    stems = {(r.term, r.id) for r in search.postings(nodes, stemmed=True).collect()}
    assert stems == {("motor", "1"), ("cat", "1"), ("a", "2"), ("motor", "2")} and search.stem_query('"Cats" motors') == "cat motor"


def test_embed(spark):
    rows = {r.id: r.embedding for r in search.embed(spark.createDataFrame([("a", "one two two"), ("b", "two ONE two"), ("c", "other"), ("d", "")], "id string, text string")).collect()}
    assert set(rows) == {"a", "b", "c"} and rows["a"] == rows["b"] and all(abs(sum(x * x for x in v) - 1) < 1e-6 for v in rows.values())


def test_concat_bodies_gathers_only_what_is_shown(spark):
    """A group far larger than the cap: the same text, and no row holds much more than the cap."""
    rows = [(f"n{i:04}", "" if i % 9 == 0 else f"t{i}", None if i % 11 == 5 else "é" * (i % 50)) for i in range(3000)]
    nodes = spark.createDataFrame(rows, "id string, title string, body_md string")
    ids = spark.createDataFrame([("all" if i % 3 else "some", i // 2, f"n{i:04}") for i in range(3000)] + [("none", 1, "n0005"), ("small", 2, "n0001"), ("small", 1, "n0003")], "group_id string, pos int, id string")
    want = {}
    for g in ("all", "some", "none", "small"):
        own = sorted((r.pos, f"## {rows[int(r.id[1:])][1] or r.id}\n{rows[int(r.id[1:])][2]}") for r in ids.collect() if r.group_id == g and rows[int(r.id[1:])][2] is not None)
        t = "\n\n".join(p for _, p in own)
        want[g] = t if len(t) <= 700 else t[:700] + f"\n[truncated — {len(t) - 700} more chars]"
    shown = listings.concat_bodies(nodes, ids, 700, 16)
    assert {r.group_id: r.text for r in shown.collect()} == want
    # the blocks are bounded, however large the group
    sizes = listings._position_blocks(ids.select("group_id", "pos", F.lit(1).cast("long").alias("room")), 16)
    assert max(r.room for r in sizes.collect()) <= 32 and sizes.agg(F.sum("room")).first()[0] == 3003
