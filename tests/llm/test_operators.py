"""Each operator against brute force on small fixtures, and on nulls, empty and odd inputs."""

import hashlib
import json
import random
import re
import sys
import time
from collections import Counter, defaultdict
from itertools import product
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tabmend.llm import near_dedup as nd
from tabmend.llm.chat_tools import canonical, format_chat
from tabmend.llm.decontaminate import decontaminate
from tabmend.llm.html_extract import extract_text, main_text, tokens
from tabmend.llm.line_dedup import _ranges as line_ranges, dedup_lines
from tabmend.llm.mixing import mix_sources, targets
from tabmend.llm.near_dedup import near_duplicates
from tabmend.llm.quality_model import fit, good_documents, score_quality
from tabmend.llm.queries import archived
from tabmend.llm.quality_rules import quality_rules, text_counts
from tabmend.llm.substring_dedup import decide, dedup_substrings, prefix_classes, repeated_runs, suffix_order
from tabmend.llm.warc import payload_of, read_segments, read_warc, unchunked, write_warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use or add.
CLASH = ["key", "n", "h", "pos", "part", "words", "size", "items", "spans", "doc", "comp", "id", "kept_"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASH})


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (3, " \n\t", None), (None, "one two", "b"), (4, words(1, 20_000), "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.mark.parametrize(
    "operator",
    [
        lambda d, s: dedup_substrings(d),
        lambda d, s: mix_sources(d),
        lambda d, s: extract_text(d, "text", "out"),
        lambda d, s: near_duplicates(d),
        lambda d, s: quality_rules(d),
        lambda d, s: dedup_lines(d),
        lambda d, s: decontaminate(d, s.createDataFrame([(1, "one two"), (2, None), (None, "x y")], "item_id long, text string")),
        lambda d, s: score_quality(d, s.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")),
        lambda d, s: good_documents(d, s.createDataFrame([], "doc_id long, quality int")),
    ],
)
def test_odd_inputs(spark, odd, operator):
    """One row per row with nulls, empty and long texts and repeats; none for an empty table."""
    assert operator(odd, spark).count() == len(ODD)
    assert operator(clashing(odd), spark).count() == len(ODD)
    assert operator(odd.limit(0), spark).count() == 0


# 1


def brute_spans(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = text.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if (x := data[s : s + length]) in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(x)
        edges = [p for p in range(len(data) + 1) if (p < len(data) and gone[p]) != (p > 0 and gone[p - 1])]
        out[i] = bytes(c for c, g in zip(data, gone, strict=True) if not g), list(zip(edges[::2], edges[1::2], strict=True))
    return out


@pytest.mark.parametrize("hot", [{}, {"sample": 1, "hot_times": 2}, {"block": 1}, {"block": 500, "wide_sent": 0}])
def test_substrings(spark, hot):
    """By the search of blocks, by leads found hot, and by leads whose runs exceed a block (sent and joined)."""
    r = random.Random(5)
    shared, loop = words(2, 60), "Der " * 80
    rows = [(i, words(100 + i, r.randint(1, 50)) + r.choice(["", " é" + shared, loop, shared[7:]]) + words(500 + i, 9)) for i in range(60)]
    rows += [(100, rows[3][1]), (101, "é" * 300), (102, "x" * 99), (103, "x" * 101)]
    want = brute_spans(rows, 100)
    got = dedup_substrings(docs(spark, [(i, t, "a") for i, t in rows]), **hot).select("doc_id", "kept", "spans", "n_bytes", "n_removed").collect()
    assert {g.doc_id: (bytes(g.kept), [tuple(x) for x in g.spans]) for g in got} == want
    assert all(g.n_bytes - g.n_removed == len(g.kept) for g in got)


def test_suffixes():
    r = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        data = r.integers(1, 3, n)
        data[r.integers(0, n, max(1, n // 40))] = 0
        told = data.tolist()
        assert list(np.argsort(suffix_order(data))) == sorted(range(n), key=lambda p: told[p:])
        # cut off at a depth, the order is right up to there
        assert [told[p : p + 8] for p in np.argsort(suffix_order(data, 8))] == sorted(told[p : p + 8] for p in range(n))
        same = prefix_classes(data, 4)
        whole = [p for p in range(n - 3) if (data[p : p + 4] != 0).all()]
        for p in whole:
            for q in whole:
                assert (same[p] == same[q]) == (data[p : p + 4] == data[q : q + 4]).all()


def test_runs_are_decided_in_any_batches():
    """Rows of a key may be cut anywhere: what is gone and what asks stays the same."""
    r = np.random.default_rng(7)
    names = ["key", "kind", "code", "none", "id", "part", "start", "size"]
    rows = sorted((int(k), int(t), int(c), False, i, 0, i, 100) for i, (k, t, c) in enumerate(
        zip(r.integers(0, 40, 400), r.integers(0, 4, 400), r.integers(0, 2, 400), strict=True)))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    told = lambda step: sorted(
        tuple(x.values()) for b in decide(batch.slice(i, step) for i in range(0, 400, step)) for x in b.to_pylist())
    want = []
    for k, t in product(range(40), (1, 2, 3)):
        group = [x for x in rows if x[0] == k and max(x[1], 1) == t]
        runs = {x[2] for x in group}
        before = None
        for x in group:
            new = before is None or before[2] != x[2]
            ask = new and (x[1] == 1 or x[1] == 0 and (len(runs) > 1 or any(y[1] != x[1] and y[2] != x[2] for y in group)))
            if ask or not new or t == 2:
                want.append((x[0], *x[3:], ask))
            before = x
    assert told(400) == sorted(want)
    assert all(told(step) == told(400) for step in (1, 2, 3, 7, 50))


def test_repeated_runs():
    """Every run with a string that another run, or the run itself, has too; short runs never."""
    r = np.random.default_rng(4)
    runs = [bytes(r.integers(97, 99, n)) for n in (0, 3, 4, 9, 30, 30, 5, 2)] + [b"xyzw", b"xyzxyzx", b"uvwxyz12"]
    ends = np.cumsum([len(x) for x in runs])
    seen = Counter(x[p : p + 4] for x in runs for p in range(len(x) - 3))
    want = [any(seen[x[p : p + 4]] > 1 for p in range(len(x) - 3)) for x in runs]
    assert repeated_runs(np.frombuffer(b"".join(runs), np.uint8), ends, 4).tolist() == want
    assert not want[-1] and want[-2]


# 2


def test_targets(spark):
    sizes = {"a": 100, "b": 10, "c": 400, None: 90}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(df, 1.5, (5, 2, 1), 2).collect()}
    weights = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:
        share = {s: left * weights[s] / sum(weights[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
        open_ -= over
    assert got == pytest.approx(want)


def test_mix(spark):
    r = random.Random(3)
    rows = [(i, words(i, r.randint(0, 60)), r.choice("aaaaab") if i % 9 else None) for i in range(600)]
    one = mix_sources(docs(spark, rows)).toPandas()
    two = mix_sources(docs(spark, rows[::-1]).repartition(7)).toPandas()
    assert one.sort_values("doc_id").taken.tolist() == two.sort_values("doc_id").taken.tolist()
    assert (one.taken == one.copies * one["size"]).all() and (one.taken <= 2 * one["size"]).all()
    for _, g in one.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.01 * g.target.iloc[0]
        assert g["size"].sum() == g.source_size.iloc[0]
    assert one.groupby("source", dropna=False).target.first().sum() == pytest.approx(1.5 * one["size"].sum())


def test_mix_small_sources(spark):
    """Sources of a few documents of very different sizes: the best combination of copies, by brute force."""
    r = random.Random(31)
    sizes = {s: [r.choice([1, 3, 40, 200, 900, 2500]) + r.randint(0, 30) for _ in range(r.randint(1, 7))] for s in "abcdefghijk"}
    rows = [(f"{s}{i}", n, s) for s, own in sizes.items() for i, n in enumerate(own)]
    given = docs(spark, [(k, " ".join(["w"] * n), s) for k, (_, n, s) in enumerate(rows)])
    got = mix_sources(given).toPandas()
    for _, g in got.groupby("source"):
        target = g.target.iloc[0]
        best = min(abs(target - sum(c * n for c, n in zip(copies, g["size"], strict=True))) for copies in product((0, 1, 2), repeat=len(g)))
        # copies change by one; what three of the values per document reach is near what all reach
        assert abs(g.taken.sum() - target) <= max(best + 1, 0.02 * target), g
        assert (g.copies <= 2).all()


def test_mix_rates(spark):
    """Rates are exp(lam * size) up to the cap, with the words of the target: the tilt by bisection."""
    r = random.Random(8)
    sizes = {s: [r.randint(1, 90) for _ in range(200 + 100 * k)] for k, s in enumerate("abc")}
    rows = [(1000 * k + i, " ".join(["w"] * n), s) for k, (s, own) in enumerate(sizes.items()) for i, n in enumerate(own)]
    got = mix_sources(docs(spark, rows)).toPandas()
    for s, own in sizes.items():
        g = got[got.source == s]
        lo, hi = -5.0, 5.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(n * min(np.exp(min(mid * n, 50.0)), 2.0) for n in own) < g.target.iloc[0] else (lo, mid)
        if g.target.iloc[0] < 1.999 * sum(own):
            assert np.allclose(g.rate, np.minimum(np.exp(np.minimum(lo * g["size"], 50.0)), 2.0), rtol=1e-5)
        assert (abs(g.copies - g.rate) < 2).all() and (abs(g.copies - g.rate) >= 1).sum() <= 24


# 3


def test_model_learns():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only the pair tells
    model = fit(x[:3000], y[:3000])
    assert (((model.score(x[3000:]) > 0.5) == y[3000:]).mean()) > 0.95
    assert np.array_equal(fit(x[:0], y[:0]).score(x[:5]), np.full(5, 0.5))


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = score_quality(d, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 1].predicted.mean() > 0.98
    kept = {r.doc_id for r in good_documents(d, labels).select("doc_id").collect()}
    assert set(got[got.predicted == 1].doc_id) <= kept and not set(got[got.predicted == 0].doc_id) & kept


# 4


def test_extract(spark):
    page = (
        '<html><head><title>T</title><script>if(a<b){}</script></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use'
        ' cookies</div><article><h1>Head &amp;\n tail</h1><p>One<br>two &eacute;<p>Three <b>b</b>old<aside>side</aside></p>'
        '<form><label>Mail</label></form></article><div id=comments><p>First!</p></div><footer>&copy; x</footer></body></html>'
    )
    assert main_text(page) == "Head & tail\nOne two é\nThree bold"
    plain = "<div><a href=1>a</a> <a href=2>b</a></div>" + "".join(f"<p>{words(i, 30)}</p>" for i in range(4)) + "<div class=footer>f</div>"
    assert main_text(plain) == "\n".join(words(i, 30) for i in range(4))
    assert [main_text(x) for x in ("", "<p>", "a<b", "<!-- x", "<script>x")] == ["", "", "a", "", ""]
    df = spark.createDataFrame([(1, None), (2, page), (2, page)], "page_id long, html string")
    assert sorted(r.text for r in extract_text(df).collect())[0] == ""


def test_extract_weighs_articles():
    """Surges decide on every page; article and main elements only weigh."""
    body = [words(i, 40) for i in range(5)]
    paragraphs = "".join(f"<p>{x}</p>" for x in body)
    text = "\n".join(body)
    cards = "".join(f'<article><h3><a href={i}>{words(20 + i, 6)}</a></h3><p>{words(30 + i, 12)}</p></article>' for i in range(4))
    assert main_text(f"<div>{paragraphs}</div><div>{cards}</div>") == text
    assert main_text(f"<main><div>{paragraphs}</div>{cards}</main>") == text
    comments = "".join(f'<article class="comment"><p>{words(40 + i, 50)}</p></article>' for i in range(3))
    assert main_text(f"<article>{paragraphs}</article><div>{comments}</div>") == text
    teasers = "".join(f'<article class="news-teaser"><p>{words(50 + i, 50)}</p></article>' for i in range(3))
    assert main_text(f"<article class='post'>{paragraphs}</article>{teasers}") == text
    assert main_text(f"<article>{paragraphs}</article><div><p>{words(60, 8)}</p></div>") == text
    short = f"<article>{paragraphs}<aside>{words(61, 9)}</aside><p>Anna</p></article>"
    assert main_text(short) == text + "\nAnna"
    plain = f"<p>{body[0]}</p><p><a href=1>more</a></p><p>Short.</p><p><a href=2>more</a></p><p>{body[1]}</p>"
    assert main_text(plain) == f"{body[0]}\nShort.\n{body[1]}"
    assert main_text(f"<main><h1>Head</h1><article>{paragraphs}</article><p>By Anna</p></main><p>x</p>") == f"Head\n{text}\nBy Anna"


# 5


def test_chat(spark):
    schemas = spark.createDataFrame(
        [("f", "x", "integer", True, 5.0), ("f", "s", "string", False, 3.0), ("g", "y", "number", False, None)],
        "name string, param string, type string, required boolean, most double",
    )
    call = '{"content":"go","tool_calls":[{"id":"2","name":"f","arguments":{"s":"abcd","x":9},"after":["1"]},{"id":"1","name":"g","arguments":"{\\"y\\":1}"}]}'
    rows = [
        (1, 1, "user", 'say "hi"'), (1, 2, "assistant", call), (1, 0, "tool", '{"tool_call_id":"1","content":"early"}'),
        (1, 3, "tool", '{"tool_call_id":"1","content":"late"}'), (1, 4, "tool", '{"tool_call_id":"9","content":"?"}'),
        (2, 1, "assistant", '{"tool_calls":[{"id":"a","name":"h","arguments":"no","after":["b"]},{"id":"b","name":"f","arguments":"[]","after":["a"]}]}'),
        (3, None, None, None), (None, 1, "user", "{not json"), (4, 1, "assistant", '{"tool_calls":[]}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = format_chat(df, schemas).collect()
    first = sorted((g for g in got if g.conv_id == 1), key=lambda g: (g.at_turn, g.level, g.number, g.step))
    assert [(g.kind, g.call_id, g.problems) for g in first] == [
        ("message", None, ""), ("message", None, ""), ("call", "1", ""), ("result", "1", ""),
        ("call", "2", "no result; over s; over x"), ("result", "1", "no call for it"), ("result", "9", "no call for it"),
    ]
    assert first[3].json == '{"content":"early","role":"tool","tool_call_id":"1"}'
    assert first[4].json == '{"arguments":{"s":"abcd","x":9},"id":"2","name":"f"}'
    assert first[0].json == '{"content":"say \\"hi\\"","role":"user"}'
    second = {g.call_id: g.problems for g in got if g.conv_id == 2 and g.kind == "call"}
    assert second == {"a": "cyclic; no result; unknown tool", "b": "cyclic; no result; no object"}
    assert Counter(g.conv_id for g in got if g.kind == "message") == {1: 2, 2: 1, 3: 1, None: 1, 4: 1}
    assert format_chat(df.limit(0), schemas).count() == 0


def test_chat_repeats(spark):
    """Equal result rows: as many as there are calls are linked, the others stay as unlinked events."""
    schemas = spark.createDataFrame([], "name string, param string, type string, required boolean, most double")
    ask = '{"content":"go","tool_calls":[{"id":"1","name":"f","arguments":"{}"}]}'
    tell = '{"tool_call_id":"1","content":"yes"}'
    rows = [(c, 1, "assistant", ask) for c in (1, None, 3, 3)] + [(c, 2, "tool", tell) for c in (1, 1, None, None, None, 3, 3, 4, 4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = format_chat(df, schemas).filter("kind = 'result'").collect()
    want = {(1, True): 1, (1, False): 1, (None, True): 1, (None, False): 2, (3, True): 2, (4, False): 2}
    assert Counter((g.conv_id, g.linked) for g in got) == want
    assert {g.at_turn for g in got if not g.linked} == {2} and {g.json for g in got} == {'{"content":"yes","role":"tool","tool_call_id":"1"}'}


def test_chat_messages_of_one_turn(spark):
    """Calls of two messages of a turn keep their own problems and order, and of two with one id one is linked."""
    schemas = spark.createDataFrame([("f", "x", "integer", True, None)], "name string, param string, type string, required boolean, most double")
    call = lambda i, name, arguments: {"id": i, "name": name, "arguments": arguments}
    sets = [[call("a", "f", '{"x":1}'), call("s", "f", '{"x":7}')], [call("b", "h", "{}"), call("s", "f", '{"x":8}')]]
    rows = [(c, t, "assistant", json.dumps({"tool_calls": calls})) for c, t in ((1, 5), (2, None), (None, 5)) for calls in sets]
    rows += [(c, 6, "tool", json.dumps({"tool_call_id": i, "content": i})) for c in (1, 2, None) for i in "abs"]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("clash"))
    got = format_chat(df, schemas).collect()
    lead = min(sets, key=lambda calls: hashlib.sha256(json.dumps({"tool_calls": calls}).encode()).hexdigest())
    for conv in (1, 2, None):
        mine = sorted((g for g in got if g.conv_id == conv), key=lambda g: (g.at_turn or 0, g.level, g.message, g.number, g.step))
        assert [(g.call_id, g.problems) for g in mine if g.kind == "call" and g.call_id in "ab"] == [
            (calls[0]["id"], {"a": "", "b": "unknown tool"}[calls[0]["id"]]) for calls in sorted(sets, key=lambda c: c is not lead)
        ]
        shared = [g for g in mine if g.call_id == "s"]
        assert [(g.kind, g.linked, g.problems) for g in shared] == [("call", True, ""), ("result", True, ""), ("call", False, "repeated call")]
        assert json.loads(shared[0].json)["arguments"] == json.loads(lead[1]["arguments"])
        for n, g in enumerate(mine):
            assert g.kind != "result" or (mine[n - 1].kind, mine[n - 1].call_id) == ("call", g.call_id)


def test_canonical_numbers(spark):
    """Equal numbers have one form; digits inside strings and keys stay."""
    forms = {
        "1": ["1", "1.0", "1e0", "10e-1", "1.00E+0"], "100": ["100", "1e2", "100.0"], "0": ["0", "-0", "0.0", "-0.0", "-0e0", "0E5"],
        "-12345678.5": ["-12345678.5", "-1.23456785e7"], "0.00000001": ["1e-8", "0.00000001", "1.0E-8"], "0.1": ["0.1", "0.10", "1e-1"],
        "1000000000000000000000000000000": ["1e30", "1" + "0" * 30], "12345678901234567890.25": ["12345678901234567890.25"],
        "120": ["1.2e2", "120"], "9007199254740993": ["9007199254740993"], "1.0E300": ["1e300"],
    }
    rows = [(want, f'{{"b": [{form}, "1.0 1.0E2 \\" 3.0E4"], "a.0": {form}}}') for want, all_ in forms.items() for form in all_]
    df = spark.createDataFrame(rows, "want string, json string")
    for r in df.select("want", "json", canonical(F.col("json")).alias("got")).collect():
        assert r.got == f'{{"a.0":{r.want},"b":[{r.want},"1.0 1.0E2 \\" 3.0E4"]}}', r.json
    odd = spark.createDataFrame([(x,) for x in (None, "", "{", '"1.0"', "1.0", "[]")], "json string")
    assert [r[0] for r in odd.select(canonical(F.col("json"))).collect()] == [None, None, None, '"1.0"', "1", "[]"]


def test_chat_order(spark):
    """Places against the rule, told call by call; a long chain is neither cut nor called a cycle."""
    r = random.Random(11)
    rows, want = [], {}
    for conv in [*range(12), None]:
        turns = {f"c{k}": r.randrange(6) if r.random() < 0.9 else None for k in range(12)}
        order = sorted(turns, key=lambda _: r.random())
        after = {c: r.sample(order[:k], min(k, r.choice([0, 1, 1, 2]))) for k, c in enumerate(order)}
        for c in order:
            own = -1 if turns[c] is None else turns[c]
            want[conv, c] = max([(own, 0), *[(t, n + 1) for t, n in (want[conv, x] for x in after[c])]])
        for turn in set(turns.values()):
            made = [{"id": c, "name": "f", "arguments": "{}", "after": after[c]} for c in order if turns[c] == turn]
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": made})))
    for k in range(1500):
        rows.append((99, k, "assistant", json.dumps({"tool_calls": [{"id": f"c{k}", "name": "f", "after": [f"c{k - 1}", "none"]}]})))
        want[99, f"c{k}"] = (k, 0)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schemas = spark.createDataFrame([("f", "x", "string", False, None)], "name string, param string, type string, required boolean, most double")
    got = format_chat(df, schemas).filter("kind = 'call'").collect()
    assert {(g.conv_id, g.call_id): (-1 if g.at_turn is None else g.at_turn, g.level) for g in got} == want
    assert not any("cyclic" in g.problems for g in got) and len(got) == len(want)


# 6


def test_signatures_estimate():
    """Agreement of coordinates is the weighted similarity, for sets and for counts."""
    r = np.random.default_rng(2)
    element = r.integers(0, 2**63, 300).astype(np.uint64)
    for weight in (np.ones(300), r.integers(1, 9, 300).astype(float)):
        a, b = np.arange(0, 250), np.arange(50, 300)
        owner = np.repeat([0, 1], 250)
        least = nd.signatures(owner, np.concatenate((element[a], element[b])), np.concatenate((weight[a], weight[b])), 2, 2000)
        want = weight[50:250].sum() / weight.sum()
        assert abs((least[0] == least[1]).mean() - want) < 0.04
        alone = nd.signatures(np.zeros(250, int), element[a], weight[a], 1, 2000)
        assert np.array_equal(alone[0], least[0])  # a set's signature depends on the set only


def test_near(spark):
    r = random.Random(8)
    base = words(9, 150).split()
    rows = []
    for i in range(300):
        w = list(base) if i % 3 == 0 else words(1000 + i, 80).split()
        for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = f"edit{r.random()}"
        rows.append((i, " ".join(w)))
    rows += [(300 + i, rows[4][1].upper()) for i in range(5)] + [(310, "short text"), (311, "Short  text"), (312, ""), (313, None)]
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))) for i, t in rows for w in [(t or "").lower().split()]}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {g.doc_id: g.class_id for g in near_duplicates(docs(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert got == {i: root(i) for i in sets}


@pytest.mark.parametrize("weights", ["set", "count"])
def test_near_in_boilerplate(spark, weights):
    """A family held together by boilerplate at 0.75 hides no pair at 0.8 to 0.85."""
    r = random.Random(12)
    base = words(77, 300).split()
    own = lambda n: [f"w{r.getrandbits(60)}" for _ in range(n)]
    rows = [(i, base + own(45)) for i in range(2000)]
    for i in range(0, 400, 2):
        mine = rows[i][1][300:]
        rows[i + 1] = (i + 1, base + mine[: r.randint(14, 22)] + own(25))
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in rows}
    assert all(max(c.values()) == 1 for c in sets.values())
    alike = lambda a, b: len(sets[a].keys() & sets[b].keys()) / len(sets[a].keys() | sets[b].keys())
    assert 0.7 < alike(1000, 1001) < 0.8
    want = {i: i for i, _ in rows} | {i + 1: i for i in range(0, 400, 2) if alike(i, i + 1) >= 0.8}
    assert sum(i != c for i, c in want.items()) > 100
    got = {g.doc_id: g.class_id for g in near_duplicates(docs(spark, [(i, " ".join(w), "a") for i, w in rows]), weights=weights).collect()}
    assert got == want


# 7


def test_counts(spark):
    rows = [(1, "a b c a b c x"), (2, "a a a a"), (3, "x y\nx y\n\nx y #$"), (4, None), (5, "é é z")]
    got = {r.doc_id: r for r in text_counts(docs(spark, [(i, t, "a") for i, t in rows])).collect()}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        at = defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        covered = {k + j for places in at.values() if len(places) > 1 for k in places for j in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got[i].n_words, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), len(covered), len(lines) - len(set(lines)))
        assert got[i].word_chars == sum(map(len, w))
        assert got[i].n_symbols == len(re.findall(r"[#*$%&|<>]", text or ""))


def test_rules_follow_the_source(spark):
    clean = [(i, words(i, 80), "s") for i in range(150)]
    marked = [(200 + i, words(200 + i, 80).replace(" ", " #"), "code") for i in range(150)]
    stray = [(400, words(400, 80).replace(" ", " #"), "s"), (401, words(401, 80), None)]
    kept = {r.doc_id: r.kept for r in quality_rules(docs(spark, clean + marked + stray)).collect()}
    assert all(kept[i] for i, _, _ in clean + marked) and not kept[400] and kept[401]


# 8


def test_warc(spark, tmp_path):
    rows = [(i, f"http://x/{i}", words(i % 7, 40 * (i % 7)) + "é<\r\n\r\nWARC/1.1\r\n") for i in range(40)] + [(50, None, None), (51, "u", "short"), (52, "u", "short")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    write_warc(df, path, segment=300, chunk=64)
    got = {r.id: r for r in read_warc(spark, path).collect()}
    assert len(got) == len(rows) and all(r.ok for r in got.values())
    for i, _, page in rows:
        data, r = (page or "").encode(), got[f"<urn:page:{i}>"]
        first = min(j for j, _, p in rows if (p or "").encode() == data)
        assert r.digest == "sha256:" + hashlib.sha256(data).hexdigest()
        if len(data) >= 100 and first != i:
            assert (r.kind, r.refers, r.payload) == ("revisit", f"<urn:page:{first}>", None)
        else:
            assert (r.kind, bytes(r.payload)) == ("response", data)
    # a record whose segment is missing is not ok
    kept = read_segments(spark, path)
    whole = kept.filter("kind = 'continuation'").agg(F.max("seg")).first()[0]
    assert whole > 2
    assert unchunked(b"3\r\nabc\r\n0\r\n\r\n") == b"abc" and unchunked(b"5\r\nabc\r\n") is None
    assert payload_of(b"HTTP/1.1 200 OK\r\n\r\nx") == b"x" and payload_of(b"x") is None


def test_warc_nulls_and_repeats(spark):
    """Every row is a record: null ids, repeated rows, one id with several payloads, other columns."""
    one, two = words(1, 60), words(2, 4000)
    rows = [(None, "a", one), (None, "a", one), (None, None, None), (3, "u", one), (3, "u", one), (3, "v", two), (4, "w", two), (5, "x", one), (6, "y", "s"), (6, "y", "s")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = Counter((r.page_id, r.uri, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.ok) for r in archived(pages).collect())
    want = Counter()
    for i, url, page in rows:
        data = (page or "").encode()
        first = min((j for j, _, p in rows if p == page and j is not None), default=None)
        again = len(data) >= 100 and first is not None and first != i
        want[(i, url or "", len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None, True)] += 1
    assert got == want
    assert archived(pages.limit(0)).isEmpty()


def test_warc_cut_off(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: {}\r\nWARC-Record-ID: <a{}>\r\n{}Content-Length: {}\r\n\r\n{}\r\n\r\n"
    block = "HTTP/1.1 200 OK\r\n\r\nhello"
    for name, last in (("short", "hel"), ("whole", "hello")):
        text = head.format("response", 1, "WARC-Segment-Number: 1\r\n", 19, block[:19]) + head.format(
            "continuation", 2, f"WARC-Segment-Number: 2\r\nWARC-Segment-Origin-ID: <a1>\r\nWARC-Segment-Total-Length: {len(block)}\r\n", len(last), last
        )
        (tmp_path / f"{name}.warc").write_bytes(text.encode())
        got = read_warc(spark, str(tmp_path / f"{name}.warc")).collect()
        assert [(r.ok, r.payload and bytes(r.payload)) for r in got] == [(name == "whole", b"hello" if name == "whole" else None)]


# 9


@pytest.mark.parametrize("batches", [1, 5])
def test_lines(spark, batches):
    r = random.Random(4)
    pool = [words(i, 4) for i in range(15)] + ["", "short", "  Tabbed LINE here\t"]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.5 else words(1000 + 31 * i + k, 3) for k in range(12))) for i in range(80)]
    rows += [(200, "  tabbed line HERE"), (201, "ÉÉÉÉÉÉÉÉÉÉÉ"), (202, "ééééééééééé")]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, t in rows:
        for line in t.split("\n"):
            first.setdefault(key(line), i)
    want = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == i) for i, t in rows}
    got = {g.doc_id: g.text for g in dedup_lines(docs(spark, [(i, t, "a") for i, t in rows]), batches=batches).collect()}
    assert got == want


def test_lines_of_named_documents(spark):
    """Ids that are text come in batches by code points, so their runs are levelled too."""
    pool = [words(i, 4) for i in range(12)]
    r = random.Random(9)
    rows = [(f"{r.choice('aZé一😀')}{i}", "\n".join(r.choice(pool) if r.random() < 0.6 else words(77 * i + k, 3) for k in range(9))) for i in range(60)]
    rows += [(rows[0][0], pool[0]), ("", pool[3]), (None, pool[1] + "\n" + pool[1]), (None, words(5000, 5))]
    order = lambda i: (i is None, i or "")
    first = {}
    for i, t in sorted(rows, key=lambda x: order(x[0])):
        for line in t.split("\n"):
            first.setdefault(line, i)
    want = Counter((i, "\n".join(x for x in t.split("\n") if len(x) < 10 or first[x] == i)) for i, t in rows)
    df = spark.createDataFrame(rows, "name string, text string")
    cuts = line_ranges(df, "name", 5)
    assert len(cuts) == 5 and cuts[0][0] is None and cuts[-1][1] is None
    assert Counter((g.name, g.text) for g in dedup_lines(df, "name", batches=5).collect()) == want
    assert dedup_lines(df.limit(0), "name", batches=5).isEmpty()


# 10


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontaminate(spark, limit):
    items = [(1, words(1, 14)), (2, words(2, 10)), (3, "two words"), (4, "the"), (5, None), (6, words(1, 14)), (7, "É x y")]
    rows = [(i, words(50 + i, 40)) for i in range(20)]
    rows += [(30, "x " + words(1, 14).upper() + " y"), (31, words(2, 9)), (32, "(Two) words, the-end"), (33, "é x y"), (34, "É X y the the"), (35, None)]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = decontaminate(docs(spark, [(i, t, "a") for i, t in rows]), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=limit)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()}
    for i, text in rows:
        w, hit, found = split(text), set(), set()
        for item, t in items:
            x = split(t)
            size = min(10, len(x))
            for s in range(len(x) - size + 1 if x else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == x[s : s + size]:
                        hit |= set(range(p, p + size))
                        found.add(str(item))
        assert got[i] == (len(w), len(hit), sorted(found))


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, d, sf)
        assert kept.columns == d.columns, name
        assert kept.select("doc_id").subtract(d.select("doc_id")).isEmpty()
    assert corpus_pipeline.run(spark, sf).agg(F.sum("taken")).first()[0] > 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """All rows of run(): scores decide first, then lines, near copies, benchmark windows and targets by plain Python."""
    import corpus_pipeline

    r = random.Random(21)
    shared = [words(500 + i, 12) for i in range(6)]
    passage = words(900, 25)
    rows = []
    for i in range(120):
        lines = [words(i, r.randint(20, 60)), *r.sample(shared, r.choice([0, 0, 1, 2])), words(1000 + i, r.randint(15, 40))]
        if i % 11 == 0:
            lines.insert(1, passage)
        if i % 10 == 9:
            lines = [*rows[-1][1].split("\n")[:-1], rows[-1][1].split("\n")[-1] + " tail"]
        if i % 4 == 1:
            lines = ["click here buy now !!! $$$ " * 8]
        rows.append((i, "\n".join(lines), None if i % 17 == 0 else f"s{i % 3}"))
    rows += [(200, "", "s0"), (201, None, "s1")]
    docs(spark, rows).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame([(i, int(i % 4 != 1), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", passage), ("b2", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    every = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {g.doc_id for g in good_documents(every, marks).collect()}
    assert {i for i in range(120) if i % 4 != 1} <= good and len(good) < len(rows)
    left = {i: (t or "", s) for i, t, s in rows if i in good}
    # lines
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    holds = defaultdict(set)
    for i, (t, _) in left.items():
        for line in t.split("\n"):
            holds[key(line)].add(i)
    gone = lambda i, line: len(key(line)) >= 10 and len(holds[key(line)]) > 1 and i != min(holds[key(line)])
    left = {i: ("\n".join(x for x in t.split("\n") if not gone(i, x)), s) for i, (t, s) in left.items()}
    # near copies
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))) for i, (t, _) in left.items() for w in [t.lower().split()]}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    left = {i: left[i] for i in left if group[i] == i}
    # benchmark
    item = passage.split()
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    dirty = lambda w: any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))
    left = {i: (t, s) for i, (t, s) in left.items() if not dirty(t.split())}
    # mix
    size = {i: len(t.split()) for i, (t, _) in left.items()}
    total = Counter()
    for i, (_, s) in left.items():
        total[s] += size[i]
    order = [*sorted(s for s in total if s is not None), *([None] if None in total else [])]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(total.values())
    while free:
        over = {s for s in free if rest * weight[s] / sum(weight[f] for f in free) > 2 * total[s]}
        if not over:
            target |= {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
        rest -= sum(target[s] for s in over)
        free -= over
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {g.doc_id: (g.size, g.source, g.source_size) for g in got} == {i: (size[i], s, total[s]) for i, (_, s) in left.items()}
    assert len(got) == len(left) < len(good) and all(abs(g.target - target[g.source]) < 1e-6 * g.target + 1e-9 for g in got)
    assert all(0 <= g.taken <= 2 * g.size for g in got)
    for s in order:
        assert abs(sum(g.taken for g in got if g.source == s) - target[s]) <= 0.02 * target[s]


def test_pipeline_near_copies(spark):
    """Rows that share an id are judged by their texts, whatever their order."""
    import corpus_pipeline

    one, two = words(1, 100), words(2, 100)
    rows = [(1, one, "a"), (1, two, "a"), (2, two + " end", "a"), (3, words(3, 60), "b"), (3, words(3, 60), "a"), (4, words(4, 60), "a")]
    rows += [(5, one + " end", "a"), (5, words(5, 60), "a"), (None, one, "a"), (None, one, "a"), (6, None, "a"), (6, "", "a")]
    want = Counter([(1, one, "a"), (1, two, "a"), (3, words(3, 60), "a"), (4, words(4, 60), "a"), (5, words(5, 60), "a"), (None, one, "a"), (None, one, "a")])
    for given in (rows, rows[::-1]):
        got = corpus_pipeline.near_copies(spark, docs(spark, given), "").collect()
        assert Counter((g.doc_id, g.text, g.source) for g in got if g.doc_id != 6) == want
        assert sum(g.doc_id == 6 for g in got) == 1


# 4, headings and broken markup


def test_headings_outside_of_articles():
    """A heading keeps what it leads to up to kept text, and is kept between kept text though it is a link."""
    one, two = words(70, 40), words(71, 40)
    lead = "<h1>Title</h1><p>short one.</p><ul><li>a b</li><li><a>linked item</a></li></ul>"
    assert main_text(f"<div>{lead}<p>{one}</p></div>") == f"Title\nshort one.\na b\nlinked item\n{one}"
    assert main_text(f"<p>{one}</p><h2><a href='#x'>Part <b>two</b></a></h2><p>{two}</p>") == f"{one}\nPart two\n{two}"
    # no heading, two lines of links, something else between, nothing kept behind
    assert main_text(f"<p>short</p><p><a>more</a></p><p>{one}</p>") == one
    assert main_text(f"<h3>Site</h3><p><a>in</a></p><p><a>out</a></p><p>{one}</p>") == one
    assert main_text(f"<h3>Site</h3><nav><p>all</p></nav><p>{one}</p>") == one
    assert main_text(f"<p>{one}</p><p><a>next</a></p><p>{two}</p>") == f"{one}\n{two}"
    assert main_text(f"<p>{one}</p><p><a>up</a></p><h3>Related</h3><p>few words</p>") == one
    assert main_text(f"<h3>Teaser</h3><p><a>x</a></p><article><p>{one}</p></article>") == one


@pytest.mark.parametrize("piece", ["<a ", "<p class=\"", "<p class='x", "<", "<a<", "<!", "<!-- ", "</p", "<a b=\"'", "<script ", "<div>", "</b></i>", "<div></p>", "<p>x", "<script>"])
@pytest.mark.parametrize("end", ["", ">", "\">"])
def test_broken_markup_in_linear_time(piece, end):
    """1 MB of anything that never ends, or ends at the last sign."""
    start = time.process_time()
    main_text("<p>Some words here.</p>" + piece * (1_000_000 // len(piece)) + end)
    assert time.process_time() - start < 20


def test_tokens():
    """The markup of small pages, against a search that tries every way from every place."""
    tag = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
    r = random.Random(6)
    for _ in range(3_000):
        page = "".join(r.choice(["<", ">", "a", "b ", "/", "\"", "'", "=", "<p ", "</p", "x\n"]) for _ in range(r.randint(1, 25)))
        want, at = [], 0
        while at < len(page):
            m = tag.match(page, at)
            if m:
                want.append((m.start(), m.end(), bool(m[1]), m[2].lower(), m[3]))
            at = m.end() if m else at + 1
        assert list(tokens(page)) == want, page


def test_comments_of_readers():
    body = "<p>" + words(3, 120) + "</p>"
    for name in ("user-comments-list", "comments", "list_of_replies", "CommentList comment"):
        page = f"<article>{body}<div class=\"{name}\"><p>{words(4, 80)}</p></div></article>"
        assert main_text(page) == words(3, 120), name
    assert words(4, 80) in main_text(f"<article>{body}<div class=\"post-content-with-sidebar\"><p>{words(4, 80)}</p></div></article>")
