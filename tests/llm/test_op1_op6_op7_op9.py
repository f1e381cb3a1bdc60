import json

import numpy as np
import pytest

from prefsight.llm import op1_tool_calls as C
from prefsight.llm import op6_merge_dropout as M
from prefsight.llm import op7_length_histogram as H
from prefsight.llm import op9_tag_path as X
from prefsight.llm import queries as Q

# --- tool calls ---


def test_canonical_json():
    value = {"b": [1, 2.0, 1.5, 1e21, 1e-7, 0.00001, 123456789012345.6, -0.0], "a": {"\u20ac": None, "\U0001f600": True, "\r": "\u2028\n"}}
    assert C.canonical(value) == ('{"a":{"\\r":"\u2028\\n","\u20ac":null,"\U0001f600":true},'
                                  '"b":[1,2,1.5,1e+21,1e-7,0.00001,123456789012345.6,0]}')
    assert json.loads(C.canonical(value)) == value
    with pytest.raises(ValueError):
        C.canonical(float("nan"))


def test_schema_violations():
    schema = {"type": "object", "required": ["q", "n"], "additionalProperties": False, "properties": {
        "q": {"type": "string", "minLength": 2, "maxLength": 3}, "n": {"type": ["integer", "null"], "minimum": 1, "maximum": 9},
        "k": {"enum": ["a", 1]}, "l": {"type": "array", "items": {"type": "boolean"}, "maxItems": 2}}}
    assert C.violations({"q": "ab", "n": 3.0, "k": 1, "l": [True]}, schema) == []
    assert C.violations({"q": {"$ref": "x"}, "n": None}, schema) == []
    assert C.violations({"q": "a", "n": 10, "k": "b", "l": [1, True, False], "z": 0}, schema) == [
        '$.k: not one of ["a",1]', "$.l: longer than 2", '$.l[0]: not of type "boolean"', "$.n: above 9",
        "$.q: shorter than 2", "$: unknown z"]
    assert C.violations({}, schema) == ["$: lacks q", "$: lacks n"]
    assert C.violations([], schema) == ['$: not of type "object"']


def link(spark, calls, results, schemas=(("t", '{"type":"object"}'),)):
    made = C.link_tool_calls(
        spark.createDataFrame([(*c, "x") for c in calls], "conv_id long, call_id string, turn long, name string, arguments string, status string"),
        spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"),
        spark.createDataFrame(list(schemas), "name string, schema string"))
    return made.collect()


def test_link_calls(spark):
    ref = '{{"x":{{"$ref":"{}"}}}}'.format
    rows = link(spark, [
        (1, "c", 0, "t", ref("b")), (1, "b", 0, "t", ref("a")), (1, "a", 0, "t", '{ "z": 1, "a": 2.0 }'),
        (1, "a", 5, "t", "{}"), (1, "l1", 1, "t", ref("l2")), (1, "l2", 1, "t", ref("l1")), (1, "m", 1, "u", ref("nowhere")),
        (2, "a", 3, "t", "not json"), (None, "a", 0, "t", None), (2, None, 0, "t", "[]"), (3, "e", 9, "t", "{}")],
        [(1, "a", 2, "two"), (1, "a", 1, "one"), (2, "x", 0, "orphan"), (None, "a", 0, "y"), (3, "e", 4, "soon"),
         (1, "c", None, "late")])
    by = {(r["conv_id"], r["call_id"], r["turn"]): r for r in rows}
    assert len(rows) == 11
    assert [by[1, c, 0]["level"] for c in "abc"] == [0, 1, 2] and [by[1, c, 0]["position"] for c in "abc"] == [0, 1, 2]
    assert (by[1, "a", 0]["status"], by[1, "a", 0]["result"], by[1, "a", 0]["n_results"]) == ("linked", "one", 2)
    assert by[1, "a", 5]["status"] == "duplicate" and by[1, "a", 5]["result"] is None
    assert by[1, "b", 0]["status"] == "no_result" and by[1, "c", 0]["status"] == "linked"
    assert by[1, "l1", 1]["level"] is None and by[1, "m", 1]["level"] is None
    assert by[1, "m", 1]["errors"] == ["$: unknown tool"] and by[2, "a", 3]["errors"] == ["$: not JSON"]
    assert by[None, "a", 0]["status"] == by[2, None, 0]["status"] == "no_id"
    assert by[3, "e", 9]["status"] == "early_result"
    assert by[1, "a", 0]["record"] == ('{"arguments":{"a":2,"z":1},"call_id":"a","conv_id":1,"errors":[],"name":"t",'
                                       '"position":0,"result":"one","status":"linked"}')
    assert link(spark, [], []) == []


def test_levels_of_a_long_chain(spark):
    """Chains, a cycle and an unknown reference; the plan stays small however long a chain is."""
    n = C.LEVEL_ROUNDS + 3
    ids = [(1, f"c{k}") for k in range(n)] + [(2, "x"), (2, "y"), (2, "z")]
    after = [(1, f"c{k}", f"c{k - 1}") for k in range(1, n)] + [(2, "x", "y"), (2, "y", "x"), (2, "z", "none")]
    levels = C.topological_levels(spark.createDataFrame(ids, "conv_id long, call_id string"),
                                  spark.createDataFrame(after, "conv_id long, call_id string, ref string"))
    assert sorted(tuple(r) for r in levels.collect()) == sorted((1, f"c{k}", k) for k in range(n))
    assert levels._jdf.queryExecution().optimizedPlan().toString().count("checkpoint") <= C.LEVEL_ROUNDS
    assert levels._jdf.queryExecution().optimizedPlan().toString().count("RDD") <= C.LEVEL_ROUNDS


def test_conversation_calls_brute_force(spark, sf):
    turns = [r.asDict() for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows = Q.run("op1_tool_calls", spark, sf).collect()
    asked = [t for t in turns if t["role"] != "assistant"]
    assert len(rows) == len(asked)
    said = {(t["conv_id"], t["turn"]): t["text"] for t in turns if t["role"] == "assistant"}
    place = {}
    for t in sorted(asked, key=lambda t: (t["conv_id"], t["turn"])):
        place.setdefault(t["conv_id"], []).append(t["turn"])
    for r in rows:
        k = place[r["conv_id"]].index(r["turn"]) + 1
        assert r["level"] == k.bit_length() - 1
        assert r["result"] == said.get((r["conv_id"], r["turn"] + 1))
        made = json.loads(r["record"])
        assert made["arguments"].get("context", {}).get("$ref") == (f"call-{place[r['conv_id']][k // 2 - 1]}" if k > 1 else None)
        assert C.canonical(made) == r["record"]
    for c, seen in place.items():
        assert sorted(r["position"] for r in rows if r["conv_id"] == c) == list(range(len(seen)))


# --- pieces ---


@pytest.fixture(scope="module")
def pieces():
    return M.Pieces(M.read_model())


def some(texts):
    return [t or "" for _, t in texts if len(t or "") < 20_000][:120] + [t or "" for _, t in texts[-14:]]


def test_without_dropout_it_is_the_model(pieces, texts):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=M.MODEL)
    mine = [t for t in some(texts) if "\u2581" not in t]
    ids = M.Encoder(pieces, 0.0).encode(mine, np.arange(len(mine)))
    assert [i.tolist() for i in ids] == sp.encode(mine)


def test_dropout_is_seeded_varied_and_lossless(pieces, texts, monkeypatch):
    mine = some(texts)
    keys = np.arange(len(mine))
    a, b, other = (M.Encoder(pieces, 0.2, s).encode(mine, keys) for s in (1, 1, 2))
    assert all((x == y).all() for x, y in zip(a, b, strict=True))
    assert sum(len(x) != len(y) or (x != y).any() for x, y in zip(a, other, strict=True)) > 0.8 * len(mine)
    assert all(M.decode(pieces, x.tolist()) == t for x, t in zip(a, mine, strict=True))
    alone = [M.Encoder(pieces, 0.2, 1).encode([t], keys[i:i + 1])[0] for i, t in enumerate(mine[:40])]
    assert all((x == y).all() for x, y in zip(a, alone, strict=False))  # whatever shares its chunk
    monkeypatch.setattr(M, "LONG", 5)  # the agenda of long words agrees with the rounds of short ones
    long = M.Encoder(pieces, 0.2, 1).encode(mine[:30], keys[:30])
    assert all(len(x) == len(y) and (x == y).all() for x, y in zip(a, long, strict=False))
    none = M.Encoder(pieces, 1.0, 1).encode(["there"], keys[:1])[0]
    assert len(none) == 6 and M.decode(pieces, none.tolist()) == "there"


def test_encode_and_decode_rows(spark, docs, empty):
    rows = M.encode_pieces(docs, keep=["doc_id", "text", "score"])
    back = M.decode_pieces(rows).collect()
    assert len(back) == docs.count() and all(r["lossless"] and r["decoded"] == (r["text"] or "") for r in back)
    assert {r["n_pieces"] for r in back if not r["text"]} == {0}
    assert M.encode_pieces(empty, keep=["doc_id"]).count() == 0


# --- lengths ---


def test_suffix_sums_brute_force(spark, docs, texts):
    with open(H.VOCABULARY, "rb") as f:
        enc = H.encoder(f.read())
    lengths = [len(enc.encode_ordinary(r["text"] or "")) for r in docs.select("text").collect()]
    answers = H.suffix_sums(H.length_counts(docs)).checkpoint()
    rows = answers.collect()
    assert [r["n_tokens"] for r in sorted(rows)] == sorted(set(lengths))
    for r in rows:
        limit = r["n_tokens"]
        assert r["n_docs"] == lengths.count(limit) and r["n_longer"] == sum(x > limit for x in lengths)
        assert r["kept_tokens"] == sum(min(x, limit) for x in lengths)
        assert r["kept_tokens"] + r["cut_tokens"] == r["total_tokens"] == sum(lengths)
        assert r["fitting"] == pytest.approx(sum(x <= limit for x in lengths) / len(lengths))
    limits = [0, 1, 7, 511, 512, 2048, 10**6]
    for r in H.at_limits(answers, limits).collect():
        assert r["kept_tokens"] == sum(min(x, r["limit"]) for x in lengths)
        assert r["n_longer"] == sum(x > r["limit"] for x in lengths)


def test_lengths_empty(empty):
    assert H.suffix_sums(H.length_counts(empty)).count() == 0


# --- pages ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="home">
<header><h1>Site name</h1></header><div id="cookie-notice"><p>We use cookies, on all pages. Fine? Yes, fine, thanks.</p></div>
<ul class="main-menu"><li><a href=/>Home</a><li><a href=/b>About</a></ul>
<div class="wrap"><h1>The &quot;title&quot;</h1><div class="post-content"><p>First, a  paragraph
with <b>bold</b>, &amp; a <a href="x">link</a>. It is long enough, surely.<p>Second: one&nbsp;more, &lt;tag&gt; &am. Good.
<blockquote>A quote, which counts.</blockquote><div class="ad-slot">Buy now, buy!</div><ul><li>point one<li>point two</ul>
<span class="advert">hidden ad</span><p>x</p></div><div class="sidebar"><p>Related, other. Things, more.</p></div>
<section id="comments"><h2>Comments</h2><p>Reader one says, a lot of things. And more, and more, and more, and so on.</p>
<p>Reader two says, a lot of things. And more, and more, and more, and so on, without an end in sight, really.</p></section></div>
<form><label>Mail</label><select><option>a<option>b</select><textarea>t</textarea></form><footer>&copy; us</footer></body></html>"""


def test_article_text():
    assert X.extract(PAGE) == ('The "title" First, a paragraph with bold, & a link. It is long enough, surely. Second: one more, '
                               "<tag> &am. Good. A quote, which counts. point one point two x")
    assert X.extract("<p>only") == "only" and X.extract("plain < text") == "plain < text"
    assert X.extract("<nav>a</nav><script>x") == X.extract("") == X.extract("<!-- a") == ""
    assert X.extract("<article><p>one.</p><p>" + "long, " * 500 + "</p></article>") == "one. " + ("long, " * 500).strip()


def test_article_text_of_several_parts_is_whole():
    def said(name, n):
        return " ".join(f"{name} number {i}, with some words, and more of them." for i in range(n))

    for first, second in ((6, 4), (4, 6), (30, 2)):  # paragraphs of each part
        want = " ".join([said("one", 5)] * first + [said("two", 5)] * second)
        a, b = f"<p>{said('one', 5)}</p>" * first, f"<p>{said('two', 5)}</p>" * second
        for page in (f"<main><article>{a}</article><article>{b}</article></main>",  # split
                     f"<article>{a}</article><ul><li><a href=/>Home</a></ul><article>{b}</article>",
                     f"<main>{a}<article>{b}</article></main>",
                     f"<article>{a}<article>{b}</article></article>",  # nested
                     f"<article>{a}</article><div>{b}</div>",
                     f"<div>{a}</div><div>{b}</div>",  # unmarked
                     f"<div><div>{a}</div><section><div>{b}</div></section></div>"):
            text = X.extract(f"<html><body><nav>x</nav>{page}<footer>y</footer></body></html>")
            assert text.replace(" Home", "") == want and ("Home" not in text or "<ul>" in page)


def test_names_drop_containers_and_not_paragraphs_of_the_article():
    long = "A sentence with some words, and more of them, number {}. " * 3
    for name in ("social", "search-results", "alert-box", "overlay", "comment", "modal", "teaser", "notice"):
        body = [long.format(*[i] * 3).strip() for i in range(6)]
        for holder in ("article", "main", "div"):
            inner = "".join(f'<p class="{name}">{t}</p>' if i in (2, 5) else f"<p>{t}</p>" for i, t in enumerate(body))
            page = (f'<body><nav>x</nav><{holder}><h1>Title</h1>{inner}<p class="advert">Buy now</p>'
                    f'<div class="{name}"><p>{long}</p></div></{holder}></body>')
            assert X.extract(page) == " ".join(["Title", *body]), (name, holder)
        assert X.extract(f'<article><p class="{name}">{body[0]}</p></article>') == body[0]


def test_plain_link_lists_beside_paragraphs_go():
    paragraphs = [f"Paragraph {i} of the text, with some words, and more of them." for i in range(5)]
    body = "".join(f"<p>{t}</p>" for t in paragraphs)
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Part {i}</a>" for i in range(5)) + "</ul>"
    rows = "<div>" + "".join(f"<div><a href=/{i}>Part {i}</a></div>" for i in range(5)) + "</div>"
    for extra in (menu, rows):
        assert X.extract(f"<body>{extra}{body}</body>") == X.extract(f"<body>{body}{extra}</body>") == " ".join(paragraphs)
    points = "<ul><li>one <a href=/1>a</a> point<li>two</ul>"  # short, and not links alone
    assert X.extract(f"<body>{body}{points}{body}</body>") == " ".join([*paragraphs, "one a point two", *paragraphs])
    assert X.extract(f"<body>{body}<p><a href=/x>All a link</a></p></body>") == " ".join([*paragraphs, "All a link"])
    assert "Part 3" in X.extract(f"<article>{body}{menu}</article>")  # an article's own list


def test_path_scores_favour_paragraphs():
    found = X.blocks(PAGE)
    score = dict(zip([b.text for b in found], X.path_scores(found), strict=True))
    assert score["A quote, which counts."] > score["Home"] and score["Site name"] < max(score.values())


def test_pages_of_the_table(spark, sf):
    import html
    import re
    rows = {r["page_id"]: r for r in Q.run("op9_tag_path", spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inner))).split())
        assert rows[r["page_id"]]["text"] == want and rows[r["page_id"]]["n_chars"] == len(want)


def test_pages_edge_cases(spark):
    frame = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (2, "u", "<p>a" * 3000, "x"), (2, "u", "<p>a" * 3000, "x")],
                                  "page_id long, url string, html string, text string")
    rows = X.extract_pages(frame, keep=["page_id", "url"]).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in rows) == [(1, 0), (1, 0), (2, 5999), (2, 5999)]
    assert X.extract_pages(frame.limit(0), keep=["page_id"]).count() == 0
