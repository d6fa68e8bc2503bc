"""HTML, chat, packing, I-Match, neighbours, mixing and toxicity: brute force, round trips, held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import chat, html_text, imatch, mixing, packing, rabitq, toxicity
from millrace.llm.queries import op8_rabitq, vocabulary
from millrace.llm.scratch import Scratch

DOCS = "doc_id long, text string, source string, id int"


# -- HTML


def page(i, body, extra=""):
    return f'<html><head><title>t{i}</title><style>p{{}}</style></head><body><header>Site {i}</header><nav><ul><li><a href="/">Home {i}</a></li></ul></nav>{extra}<div class="story"><h2>Title {i}</h2>{body}</div><div class="comments"><p>nice {i}</p></div><aside>more</aside><form>search</form><footer>&copy; {i}</footer></body></html>'


def test_html_by_template_and_marks(spark):
    body = "<p>One &amp; <b>tw</b>o,<br>three\n  four<p>five &lt;six&gt;<script>var x='</p>'</script><!-- no --><div class='ad'>buy</div>"
    rows = [(i, f"http://a.example/{i}", page(i, f"{body}<p>{i}</p>")) for i in range(6)]
    rows += [(10, "http://b.example/", "<body><article><h1>H</h1><p>x</article><p>y"), (11, None, None), (12, "::bad::", ""), (13, "http://c.example", "plain text & more"), (14, "http://d.example/", "<p>cut <b"), (15, "http://e.example/", "<p>" + "word " * 60_000), (0, "http://a.example/0", page(0, f"{body}<p>0</p>"))]
    df = spark.createDataFrame([(i, u, h, "t") for i, u, h in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html_text.main_text(df).collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert by[2] == "Title 2 One & two, three four five <six> 2" and got.count((0, by[0])) == 2
    assert (by[10], by[11], by[12], by[13], by[14]) == ("H x", "", "", "plain text & more", "cut")
    assert len(by[15]) == 60_000 * 5 - 1
    assert html_text.main_text(df.where("false")).count() == 0


def site_page(rng, i, kind):
    words = lambda n: " ".join(rng.choice(["the", "of", f"w{rng.randint(0, 400)}", "and", "x"]) for _ in range(n))
    menu = "<div>Home page</div><div>About us</div>" if kind != "lacking" or i % 9 else ""
    items = "".join(f"<li>Item {words(1)}</li>" for _ in range(rng.randint(0, 4)))
    middle = f"<h1>Title {i}</h1><p>{words(30)}</p><ul>{items}</ul><p>Read on: {words(25)} once</p>"
    order = ["<div>Copyright Acme Corp</div>", "<div>All rights reserved</div>"]
    if kind == "mixed" and i % 2:
        order.reverse()
    return f"<html><body>{menu}{middle}{''.join(order)}</body></html>"


def template_words(pages):
    """ExAlg's classes again, with whole occurrence vectors of (path, word) and path tokens, on the pages of one host."""
    from collections import Counter, defaultdict

    found = [[(t, p) for t, p in html_text._tokens(*html_text.parse(h))] for h in pages]
    counts = [Counter(f) for f in found]
    vectors = {tp: tuple(c[tp] for c in counts) for tp in set().union(*counts)}
    on = {tp: sum(map(bool, v)) for tp, v in vectors.items()}
    many = {tp for tp in vectors if on[tp] >= html_text.SUPPORT and on[tp] >= html_text.SHARE * on[(tp[1], tp[1])]}
    classes = defaultdict(set)
    for tp in many:
        classes[vectors[tp]].add(tp)
    classes = {v: ts for v, ts in classes.items() if len(ts) >= html_text.MEMBERS}

    def valid(members):
        if len(members) < html_text.MEMBERS:
            return False
        orders = set()
        for f in found:
            sequence = [tp for tp in f if tp in members]
            n = len(set(sequence))
            if sequence and sequence != sequence[:n] * (len(sequence) // n):
                return False
            orders |= {tuple(sequence[:n])} if sequence else set()
        return len(orders) == 1

    out = set()
    for members in classes.values():
        parts = [members] if valid(members) else [{tp for tp in members if tp[1] == path} for path in {p for _, p in members}]
        out |= {t for part in parts if valid(part) for t, p in part if t != p}
    return out


@pytest.mark.parametrize("kind", ["plain", "lacking", "mixed"])
def test_html_template_against_whole_vectors(spark, kind):
    rng = random.Random(kind)
    sites = {f"{n}.example": [site_page(rng, i, kind) for i in range(n)] for n in (1, 2, 3, 12, 40)}
    rows = [(f"http://{host}/{i}", h) for host, pages in sites.items() for i, h in enumerate(pages)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(5)
    got = {r.h: set(r.words or ()) for r in html_text.templates(df, Scratch(spark, "test")).collect()}
    for host, pages in sites.items():
        assert got.get(html_text.hash_of(host), set()) == template_words(pages), host
    text = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    for i, (u, h) in enumerate(rows):
        if "40.example" in u and kind != "mixed":  # there the class is not in order, so its words stay
            body = [b for b, _ in html_text.parse(h)[0]]
            assert text[i] == " ".join(b for b in body if b not in ("Home page", "About us", "Copyright Acme Corp", "All rights reserved"))


def test_html_odd_markup():
    got = lambda h: html_text.extract(h)
    assert got("<script>for(i=0;i<n;i++){}</script><p>Main text") == "Main text"
    assert got("<style>a>b{}</style><p>x<SCRIPT>'</p>'</SCRIPT >y</p><script>rest <p>z") == "xy"
    assert got("<p>a <a href=x' >link</a> <a title='q>r' href=/a/b>two</a>") == "a link two"
    assert got('<p>a <img alt="open>b</p>c') == "a b c"
    assert got("<!--><p>one<!-- x --!>two<!-- > --> three</p></ >four") == "onetwo three four"
    assert got("<p>1 < 2, a<3 &amp;lt; &eacute;&#233;&#xe9;&nbsp;&nbsp;x</p>") == "1 < 2, a<3 &lt; ééé x"
    assert got('<div class="content-with-sidebar"><p>Body') == "Body"
    assert got('<div class="two-side layout"><article>Text here</article></div>') == "Text here"
    assert got("<form><div><h1>T</h1><p>all of it, the page is a form</p></div></form>") == "T all of it, the page is a form"
    assert got("<article><p>said</p><div class='discussion'><p>no, no, no and no again</p></div><div class=ad>buy</div><aside>more</aside></article>") == "said"
    assert got("<article><div class=comment>only this</div></article>") == "only this"
    assert got("<ul><li>a<li>b</ul>f g h i j k l<table><tr><td>c<td>d<tr><td>e</table>") == "a b f g h i j k l c d e"
    assert got('<a href="' + "x" * 200_000) == "" and got("<" * 50_000).count("<") == 50_000


# -- chat


@settings(deadline=None)
@given(st.text(), st.text(), st.text())
def test_chat_round_trip(a, b, role):
    for text in (a, a + "<|end|>\n" + b, "<\\|end|>" + a, "</s>[INST] ok [/INST]" + b, a + "<" + "|text|>"):
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)
        clean = role.replace("\\", "\\\\").replace("\n", "\\n")
        formatted = f"{chat.OPEN}{chat.escape(clean)}{chat.CLOSE}{chat.escape(text)}{chat.END}" * 2
        assert chat.read_turns(formatted) == [(role, text)] * 2


def test_chat_digests(spark):
    import hashlib

    rows = [(1, 0, "user", "a<|end|>\nb"), (1, 1, "assistant", "c [INST] é"), (1, 2, "assistant", None), (2, 0, None, ""), (None, 0, "ass\nis\\t", "x"), (3, None, "user", "z"), (3, 0, "assistant", "y" * 200_000), (1, 1, "assistant", "c [INST] é")]
    df = spark.createDataFrame([(*r, "f") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(t for _, r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(df.where("false"))).count() == 0


def test_chat_layouts_ignore_other_fields(spark):
    turns = lambda record: chat.canonical(record)
    said = [{"role": "user", "content": "q", "name": "x"}, {"role": "assistant", "content": "a"}]
    assert turns({"id": 7, "messages": said, "source": {"url": "u"}}) == [("user", "q"), ("assistant", "a")]
    assert turns({"id": 7, "messages": []}) == [] and turns({"a": 1}) is None
    assert turns({"instruction": "i", "output": "o", "id": 1}) == [("user", "i"), ("assistant", "o")]
    assert turns({"instruction": "i", "input": "", "output": "o"}) == [("user", "i"), ("assistant", "o")]
    assert turns({"system": "s", "prompt": "p", "completion": None}) == [("system", "s"), ("user", "p"), ("assistant", "")]
    for key, m in chat.MAPPINGS.items():
        assert key == chat.fingerprint(m.paths) == chat.layout_of({*m.paths, "zz", "meta.id"})
    rows = spark.createDataFrame([("human", None, "s"), ("gpt", "v", "s")], "from string, value string, prompt string")
    assert [(r.role, r.text) for r in chat.row_turns(rows).collect()] == [("user", ""), ("assistant", "v")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.row_turns(rows.select("prompt"))


def test_chat_layouts(spark):
    rows = [("1", '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}'), ("2", '{"instruction":"do","input":"it","output":"done"}'), ("3", '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}'), ("4", '{"x":1}'), ("5", "nope"), ("6", None), ("7", '{"prompt":"p","response":"r"}')]
    got = [(r.i, r.role, r.text, r.problem) for r in chat.turns_from_json(spark.createDataFrame(rows, "i string, j string"), "j", "i").orderBy("i", "turn").collect()]
    assert got == [("1", "user", "q", None), ("1", "assistant", "a", None), ("2", "user", "do\n\nit", None), ("2", "assistant", "done", None), ("3", "user", "q", None), ("3", "assistant", "a", None), ("4", None, None, "unknown layout"), ("5", None, None, "not JSON"), ("6", None, None, "not JSON"), ("7", "user", "p", None), ("7", "assistant", "r", None)]


# -- packing


@settings(deadline=None)
@given(st.lists(st.one_of(st.text(), st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "\n\n", "'ll"]))).map("".join))
@example("a<|endoftext|>b")
@example("<|endoftext|><|endoftext|> <|endoftext|>")
def test_ids_are_the_tokenizers(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    cache = packing.process_cache().__dict__
    hf = cache.setdefault("test-hf", None) or cache.__setitem__("test-hf", Tokenizer.from_file(path("byte_bpe_50k.json"))) or cache["test-hf"]
    assert packing.byte_bpe(vocabulary())(text) == hf.encode(text, add_special_tokens=False).ids


def test_ids_of_every_character_and_added_token():
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(vocabulary())
    encode = packing.byte_bpe(vocabulary())
    for token in hf.get_added_tokens_decoder().values():
        assert encode(f"a{token.content}b") == hf.encode(f"a{token.content}b", add_special_tokens=False).ids
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}! {chr(c)}" for c in points[i : i + 20_000 : 7]]
        assert [encode(t) for t in texts] == [e.ids for e in hf.encode_batch(texts, add_special_tokens=False)]


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "Ünï", "x1", "\n"]) for _ in range(rng.randint(0, 900))) for _ in range(300)] + [None, "", "word " * 30_000, "same", "same"]
    df = spark.createDataFrame([(i if i < 303 else 303 if i < 305 else None, t, "s", 1) for i, t in enumerate(texts)], DOCS)
    scratch = Scratch(spark, "test")
    items = scratch.keep(packing.pieces(df.select("doc_id", "text"), vocabulary()))
    rows = packing.pack(items, scratch, per_task=40).collect()
    encode = packing.byte_bpe(vocabulary())
    ids = {i: [*encode(t or ""), 2] for i, t in enumerate(texts)}
    seen, bins = {}, {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for i in range(303):
        parts = sorted(seen[i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and all(p.length == 1024 for p in parts[1:])
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[i][p.start : p.start + p.length], "<u4").tobytes())
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:], strict=False)) and sum(b[-1]) <= 1024
    assert len(bins) <= math.ceil(sum(map(len, ids.values())) / 1024) * 1.03 + 1
    assert packing.best_fit_packing(df.where("false"), vocabulary()).count() == 0


def test_best_fit_places_all():
    rng = random.Random(1)
    sizes = [rng.randint(1, 1024) for _ in range(5000)]
    bins = packing.best_fit(sizes, 1024)
    assert sorted(i for b in bins for i in b) == list(range(5000)) and max(sum(sizes[i] for i in b) for b in bins) <= 1024
    assert len(bins) <= math.ceil(sum(sizes) / 1024) * 1.02


def test_plan_is_best_fit():
    rng = random.Random(8)
    for most in (1024, 400, 30):
        sizes = [rng.randint(1, most) for _ in range(3000)] + [1024] * 5
        rows = packing.plan({s: sizes.count(s) for s in set(sizes)}, 1024).tolist()
        used = {}
        for i, (size, rank, base, fill, first) in enumerate(rows):
            end = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == size else sizes.count(size)
            for r in range(end - rank):
                b, at = first + r // fill, base + r % fill * size
                assert used.get(b, 0) == at
                used[b] = at + size
        assert sorted(used.values()) == sorted(sum(sizes[i] for i in b) for b in packing.best_fit(sizes, 1024))
    assert len(packing.plan({s: 10**12 + s for s in range(1, 1025)}, 1024)) < 10_000


def test_packing_does_not_depend_on_blocks(spark):
    """Sizes that don't combine with like ones: the number and fill of sequences are those of one best fit, however tasks are cut."""
    rng = random.Random(9)
    sizes = [rng.choice([400, 600, 620, 350, 3, 1024]) for _ in range(900)]
    items = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    want = sorted(sum(sizes[i] for i in b) for b in packing.best_fit(sizes, 1024))
    for per_task, parts in ((40, 1), (7, 5), (50_000, 3)):
        bins = {}
        for r in packing.pack(items.repartition(parts), Scratch(spark, "test"), per_task=per_task).collect():
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sorted(sum(n for _, n in b) for b in bins.values()) == want
        assert all(sorted(b)[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(sorted(b), sorted(b)[1:], strict=False)) for b in bins.values())


# -- I-Match


def test_imatch_pairs_and_likeness(spark):
    import hashlib

    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(1, 120))) for _ in range(200)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, texts[0]), (9002, texts[0]), (None, "nobody"), (9003, "z" * 200_000)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], DOCS).repartition(7)
    band = imatch.lexicon(df)
    got = sorted(imatch.edited_likeness(df, band, Scratch(spark, "test")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(got) == len(rows)
    for r, (i, t), (_, nxt) in zip(got, rows, rows[1:] + rows[:1], strict=True):
        n = len(t)
        edited = t[: n - n // 4] + nxt[: n // 4]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (imatch.fingerprint(t, band), imatch.fingerprint(edited, band))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (t != edited or r.near_edited == 1)
    long = [r for r in got if (r.n_chars or 0) > 300 and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.near_edited for r in long) > 4 * sum(r.near_next for r in long)
    one = spark.createDataFrame([(1, "only one", "s", 1)], DOCS)
    assert imatch.edited_likeness(one, band, Scratch(spark, "test")).first().near_next == 1.0
    assert imatch.edited_likeness(one.where("false"), imatch.lexicon(one.where("false")), Scratch(spark, "test")).count() == 0


def imatch_by_definition(text, band):
    """The definition again, term by term, with Python's integers."""
    import re

    from xxhash import xxh64_hexdigest, xxh64_intdigest

    top = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & top
        return x ^ (x >> 31)

    found = {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")}
    terms = sorted({xxh64_intdigest(w.encode()) for w in found} & set(band))
    if not terms:
        return xxh64_hexdigest((text or "").encode()) + "0" * 4 * imatch.LEXICONS
    out = [xxh64_hexdigest(b"".join(t.to_bytes(8, "little") for t in terms))]
    for seed in imatch._SEEDS.tolist():
        for k in range(1, imatch.SHARES + 1):
            own = [t for t in terms if mix(t ^ seed) < 1 << (64 - k)]
            h = xxh64_intdigest(b"".join(t.to_bytes(8, "little") for t in own), k) % 65535 + 1
            out.append(f"{h:04x}" if own else "0000")
    return "".join(out)


def test_imatch_by_definition(spark):
    from collections import Counter

    from xxhash import xxh64_intdigest

    rng = random.Random(9)
    texts = [" ".join(rng.choice(["Alpha", "b%d" % rng.randint(0, 400), "é%d" % rng.randint(0, 50), "the"]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "the the"]
    band = imatch.lexicon(spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], DOCS))
    df = Counter(w for t in texts for w in {x.lower() for x in (t or "").split()})
    assert band.tolist() == sorted(xxh64_intdigest(w.encode()) for w, n in df.items() if 2 <= n <= int(0.05 * len(texts)))
    for t in [*texts, "b1 b2, b3;é7 THE", "nothing known"]:
        assert imatch.fingerprint(t, band) == imatch_by_definition(t, band.tolist())
    a = imatch.fingerprint("b1 b2 b3 b4", band)
    assert imatch.likeness(a, imatch.fingerprint("b4 b3 the b2 b1", band)) == 1.0 and imatch.likeness(a, imatch.fingerprint("nothing known", band)) == 0.0


# -- neighbours


def exact(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_neighbours_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(rabitq, "CELL", 300)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 30))
    if kind == "clusters":
        x += 4 * rng.standard_normal((12, 30))[rng.integers(0, 12, 1500)]
    if kind == "copies":
        x[:600] = x[0]
    x = x.astype(np.float32).astype(np.float64)
    ids = np.arange(1500)
    odd = [(5000, None), (5020, [0.0] * 30), (5040, [None] * 30), (5060, [float("nan")] * 30), (5080, [float("inf")] + [0.0] * 29), (None, [1.0] * 30), (5100, [1.0] * 7)]
    df = spark.createDataFrame([(int(i), v.tolist(), 1.0) for i, v in zip(ids, x, strict=True)] + [(i, v, 1.0) for i, v in odd], "vec_id long, embedding array<float>, score double")
    got = {}
    for r in rabitq.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    want = exact(ids, x, 20)
    assert set(got) == set(want) and all([r[2] for r in v] == list(range(1, 21)) for v in got.values())
    hits = sum(len({a for a, _, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert all(abs(s - float((x[q] * x[v]).sum())) < 1e-12 for q in got for v, s, _ in got[q])
    assert rabitq.nearest(df.where("vec_id > 4999"), F.col("vec_id") % 20 == 0).count() in (0, 20)


def test_neighbours_recall_on_the_table(spark):
    """The production parameters on the embeddings themselves, against brute force."""
    import pandas as pd

    table = pd.read_parquet("/root/testdata/sf0.01/embeddings.parquet")
    vector = next(c for c in table.columns if c != "vec_id" and isinstance(table[c].iloc[0], np.ndarray))
    fine = table[[v is not None and np.isfinite(np.asarray(v, float)).all() and np.any(v) for v in table[vector]]]
    want = exact(fine.vec_id.to_numpy(), np.stack(fine[vector]).astype(float), 20)
    got = {}
    for r in op8_rabitq(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(want)
    recall = [len(got[q] & {a for a, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(recall) >= 0.9


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r["rank"]) for r in rabitq.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert rabitq.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


# -- mixing


def test_mixing_weights_and_budget(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 60), "big" if i % 3 else f"s{i % 4}", 1) for i in range(3000)]
    rows += [(9000, None, "void", 1), (9001, "a b", None, 1), (9001, "a b", None, 1), (None, "c d e", "s1", 1), (9002, "w " * 5000, "s2", 1)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df, entropy=0.98, max_repeats=3.0)
    got = out.collect()
    words = {}
    for i, t, s, _ in rows:
        words[s] = words.get(s, 0) + len((t or "").split())
    taken, weights = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
        weights[r.source] = r.mix_weight
    total = sum(words.values())
    assert sum(w for w in weights.values()) == pytest.approx(1, abs=1e-9)
    for s in words:
        assert taken.get(s, 0) <= weights[s] * total + 1 and taken.get(s, 0) / max(words[s], 1) <= 3.001
        assert taken.get(s, 0) >= weights[s] * total - max(len((t or "").split()) for _, t, x, _ in rows if x == s) * 2 or s is None
    assert sum(1 for r in got if r.source == "void") == 1 and out.columns[:4] == df.columns
    assert mixing.mix(df.where("false")).count() == 0
    clash = mixing.mix(df.withColumn("mix_key", F.lit(1)).withColumn("mix_weight", F.lit("x")))
    assert sorted(clash.columns) == sorted(out.columns) and dict(clash.dtypes)["mix_weight"] == "double"
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# -- toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    bad, good = ["vile", "slurring", "slurred"], [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 8 == 0
        ws = [rng.choice(good) for _ in range(rng.randint(20, 150))] + ([rng.choice(bad) for _ in range(3)] if toxic else [])
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), "s", 1))
        if i < 700:
            labels.append((i, int(not toxic), int(toxic)))
    rows += [(5000, None, "s", 1), (5001, "", "s", 1), (None, "VILE vile", "s", 1), (0, rows[0][1], "s", 1), (5002, "w1 " * 100_000, "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.with_toxicity(df, lab).collect()
    assert len(got) == len(rows)
    unseen = [r for r in got if r.doc_id is not None and 700 <= r.doc_id < 1200]
    assert sum((r.p_toxic >= 0.5) == (r.doc_id % 8 == 0) for r in unseen) / len(unseen) > 0.97
    clash = toxicity.with_toxicity(df.withColumn("p_toxic", F.lit("x")), lab)
    assert dict(clash.dtypes)["p_toxic"] == "double" and len(clash.columns) == len(df.columns) + 2
    none = toxicity.with_toxicity(df, lab.where("false"))
    assert none.where("p_toxic > 0.01").count() == 0 and toxicity.with_toxicity(df.where("false"), lab, train_docs=df).count() == 0


def chain_by_hand(texts, ys, folds, score):
    """The classifier chain again on dense tables, term by term: (probabilities of the texts in score, link by link)."""
    names = sorted(set().union(*map(toxicity.terms_of, texts)))
    table = np.array([[n in ts for n in names] for ts in map(toxicity.terms_of, texts)], float)
    asked = np.array([[n in ts for n in names] for ts in map(toxicity.terms_of, score)], float)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(y, before, use):
        n, a = use.sum(), y[use].sum()
        chosen = []
        for j in range(len(names)):
            every, pos = table[use, j].sum(), table[use & y, j].sum()
            want = every * a / n
            chi = (pos - want) ** 2 / max(want * (1 - a / n) * (1 - every / (n + 1)), 1e-9) if every > 1 else 0
            if chi > toxicity.SIGNIFICANT and table[:, j].sum() >= toxicity.LEAST:
                chosen.append((-chi, j))
        chosen = [j for _, j in sorted(chosen)[: toxicity.TERMS]]
        x = np.c_[np.ones(len(y)), before, table[:, chosen]]
        w, penalty = np.zeros(x.shape[1]), np.r_[1e-4, np.full(x.shape[1] - 1, toxicity.RIDGE)]
        for _ in range(60):
            p = sigmoid(x[use] @ w)
            w -= np.linalg.solve(x[use].T @ np.diag(p * (1 - p)) @ x[use] + np.diag(penalty), x[use].T @ (p - y[use]) + penalty * w)
        return chosen, w, sigmoid(x @ w)

    before, out = np.zeros((len(texts), 0)), np.zeros((len(score), 0))
    for y in ys:
        chosen, w, _ = fit(y, before, np.ones(len(y), bool))
        out = np.c_[out, sigmoid(np.c_[np.ones(len(score)), out, asked[:, chosen]] @ w)]
        unseen = np.zeros(len(y))
        for k in range(toxicity.FOLDS):
            unseen[folds == k] = fit(y, before, folds != k)[2][folds == k]
        before = np.c_[before, unseen]
    return out


def test_toxicity_chain_by_hand(spark):
    rng = random.Random(21)
    texts, quality, toxic = [], [], []
    for i in range(260):
        bad = i % 6 == 0
        ws = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(3, 25))] + (["vile", rng.choice(["slur", "slurs"])] if bad and rng.random() < 0.9 else []) + (["fine"] if not bad and rng.random() < 0.7 else [])
        texts.append(" ".join(ws))
        quality.append(not bad and rng.random() < 0.9)
        toxic.append(bad)
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], "s", 1)], DOCS)
    lab = spark.createDataFrame([(i, int(q), int(t)) for i, (q, t) in enumerate(zip(quality, toxic, strict=True)) if i < 200], "doc_id long, quality int, toxic int")
    folds = np.array([r.f for r in spark.range(200).orderBy("id").select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(toxicity.FOLDS)).alias("f"), "id").orderBy("id").collect()])
    got = {r.doc_id: (r.p_quality, r.p_toxic) for r in toxicity.with_toxicity(df, lab).collect()}
    want = chain_by_hand(texts[:200], [np.array(quality[:200]), np.array(toxic[:200])], folds, texts)
    assert np.abs(np.array([got[i] for i in range(260)]) - want).max() < 1e-4
