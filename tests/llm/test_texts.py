"""Operators on single documents against SQL, regular expressions, the tokenizer libraries and plain Python."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import op1_quality as op1
from siftwell.llm import op2_secrets as op2
from siftwell.llm import op3_decontamination as op3
from siftwell.llm import op4_sharding as op4
from siftwell.llm import op5_tokenfile as op5
from siftwell.llm import op7_html as op7
from siftwell.llm import op8_tokencount as op8
from siftwell.llm.pieces import Encoder, tokenizer_path

from .texts import corpus

ODD = ["a  b\n\n c <|endoftext|> d<|endoftext|>e's  ", "", "  ", "x y z  b", "́a b́ ΑΣ. don't İ H̱", "ALL CAPS!! #$% (x)", "a " * 3000 + "end"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def all_rows():
    rows = corpus(2)
    return rows + [(10_000 + k, t) for k, t in enumerate(ODD)]


def test_ledger_like_sql(spark):
    docs = frame(spark, all_rows())
    got = {r["doc_id"]: tuple(r)[1:] for r in op1.ledger(docs).select("row.doc_id", *op1.MEASURES, "bits").collect()}
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(all_rows(), columns=["doc_id", "text"]))
    want = {r[0]: tuple(r[1:]) for r in con.sql(f"WITH {op1.measure_sql('documents')} SELECT doc_id, {', '.join(op1.MEASURES)}, bits FROM f").fetchall()}
    assert got == want


def test_policies_and_ablations(spark):
    docs = frame(spark, all_rows())
    led = op1.ledger(docs).select("bits").cache()
    bits = [r.bits for r in led.collect()]
    whole = op1.mask("default", 2)
    for r in op1.ablations(led, version=2).collect():
        bit = 1 << list(op1.RULES).index(r["rule"])
        assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(b & bit > 0 for b in bits), sum(b & whole == bit for b in bits), sum(b & whole & ~bit == 0 for b in bits))
    assert op1.judged(docs, version=2).count() == sum(b & whole == 0 for b in bits)
    assert op1.judged(docs).count() == sum(b & op1.mask() == 0 for b in bits)
    clash = spark.createDataFrame([(None, "x", 1, 2)], "doc_id long, text string, bits int, words int")
    assert op1.judged(clash, policy="lenient").count() == 0 and op1.ledger(clash.where("false")).count() == 0


def test_very_long_clean_text_stays(spark):
    r = random.Random(8)
    book = " ".join(f"word{r.randrange(500)}" for _ in range(20_000))
    docs = spark.createDataFrame([(1, book)], "doc_id long, text string")
    led = op1.ledger(docs).first()
    assert led.bits == 1 << list(op1.RULES).index("few_distinct")
    assert op1.judged(docs).count() == 1 and op1.judged(docs, version=2).count() == 0


def test_secrets_like_regular_expressions(spark):
    plain = [(re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), 2, 6), (re.compile(rb"AKIA[A-Z0-9]+"), 0, 20), (re.compile(rb"[0-9a-f]+"), 0, 24)]
    brute = lambda d: sorted((m.start(), k, m.end()) for k, (r, g, n) in enumerate(plain) for m in r.finditer(d) if len(m[g]) >= n)
    r = random.Random(5)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", " ", "=", ":", '"', "AKIA", "ABCDEF0123456789", "abc", "deadbeef01234567", "é", "x", "tok", "=abcdefg"]
    scan = op2.scanner(op2.RULES)
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    for t in texts:
        assert [s for s in scan.spans(t.encode()) if s[1] < 3] == brute(t.encode())
    extra = "é ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY----- eyJabcd.eyJefgh.sigsigsigsigsigsigsig1"
    rows = [(1, extra), (2, None), (3, ""), (None, "secret=abcdef")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in op2.scan(frame(spark, rows)).collect()}
    assert [k for k, *_ in got[1]] == ["github", "private_key", "jwt"] and got[1][0][1:] == (2, 42)
    assert got[2] == got[3] == [] and got[None] == [("assign", 0, 13)]


def test_decontamination_like_search(spark, monkeypatch):
    rows = corpus(9)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    long = [t for _, t in rows if t and len(words(t)) > 40]
    items = [(0, " ".join(words(long[0])[5:30])), (1, " ".join(words(long[1])[3:13]).upper()), (2, "one"), (3, None), (4, "no such words here"), (5, "a b c"), (6, " ".join(words(long[0])[5:30])), (11, "...")]
    want = {}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for k, text in items:
            q = words(text)
            n = min(10, len(q))
            for a in range(len(q) - n + 1) if n else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == q[a : a + n]:
                        hit |= set(range(b, b + n))
                        found.add(k)
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (op3.BLOCK_BYTES, 60):
        monkeypatch.setattr(op3, "BLOCK_BYTES", block)
        got = {r[0]: tuple(r)[1:] for r in op3.contamination(frame(spark, rows), bench).collect()}
        assert got == want
    index = op3.build_index(frame(spark, [(1, "a x b y c"), (2, "c a z z z b"), (3, "a b")]))
    near = {(r["query"], r.doc_id) for r in op3.proximity(index, {"q": ["a", "b", "c"]}, 4).collect()}
    assert near == {("q", 1), ("q", 2)}


def test_decontamination_keeps_item_ids_as_they_are(spark):
    """Null and string ids, one id of two items, an empty benchmark, an empty table, further columns."""
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, text, 7), (None, "x " + text, 7), (3, None, 7)], "doc_id long, text string, items int")
    items = [("b", text), (None, text), ("b", text[4:]), ("a", None)]
    digest = hashlib.sha256(b",b,b").hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in op3.contamination(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert got == {1: (11, 11, 3, digest, True), None: (12, 11, 3, digest, True), 3: (0, 0, 0, none, False)}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in op3.contamination(docs, empty).collect()] == [0, 0, 0]
    assert op3.contamination(docs.where("false"), empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000, 4097])
def test_permutation(n):
    rows = np.arange(n)
    at = op4.permute(rows, n, 3)
    assert sorted(at.tolist()) == list(range(n)) and (op4.permute(at, n, 3, back=True) == rows).all()
    assert n < 64 or (at != op4.permute(rows, n, 4)).any()


def test_shards(spark):
    rows = all_rows() + [(3, "same"), (3, "same"), (None, None)]
    for parts in (1, 5):
        got = op4.shards(frame(spark, rows).repartition(parts), ["doc_id", "text"], k=8).select("doc_id", "text", "place", "shard", "slot", "row_number").collect()
        size = [sorted(r.slot for r in got if r.shard == k) for k in range(8)]
        assert max(map(len, size)) - min(map(len, size)) <= 1 and all(s == list(range(len(s))) for s in size)
        assert [r.doc_id for r in sorted(got, key=lambda r: r.row_number)] == sorted([r[0] for r in rows], key=lambda i: -1 if i is None else i)
    assert op4.shards(frame(spark, rows).where("false"), ["doc_id"]).count() == 0


def test_pieces_like_the_library():
    from tokenizers import Tokenizer

    texts = [t or "" for _, t in all_rows()]
    for name, cut in ((op5.TOKENIZER, "spaces"), (op8.TOKENIZER, "before_space")):
        want = [e.ids for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]
        ids, n = Encoder(name, cut, True).ids(pa.array(texts, pa.large_string()))
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_odd_rows_are_cut_too():
    """White space beyond ASCII and special tokens withhold only the cuts next to them."""
    from tokenizers import Tokenizer

    r = random.Random(7)
    parts = ["a", "Word", "été", " ", "  ", "\n", "\u00a0", "\u2003", "\u3000", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "<", "x.y", "'s", "!?", "12", "\u0301"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(3000)]
    texts += [" ".join(["one, two"] * 5000) + odd + " ".join(["three. four"] * 5000) for odd in ("\u00a0", "<|endoftext|>", " \u2003 ")]
    for name, cut in ((op5.TOKENIZER, "spaces"), (op8.TOKENIZER, "before_space")):
        want = [e.ids for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]
        col = pa.array(texts, pa.large_string())
        ids, n = Encoder(name, cut, True).ids(col)
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
        assert max(len(p) for p in Encoder(name, cut, False)._pieces(col[-3:])[0].to_pylist()) < 50


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = all_rows()
    folder = f"file://{tmp_path}/ids"
    files = op5.write_ids(frame(spark, rows), folder)
    tok = Tokenizer.from_file(tokenizer_path(op5.TOKENIZER))
    start, want = 0, {}
    for i, t in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r[0]: tuple(r)[1:] for r in op5.read_ids(spark, folder, files).collect()} == want
    with open(files[0][0], "rb") as source:
        reader = op5.Reader(source)
        doc = int(reader.frame(0)[0][-1])
        assert [zlib.crc32(x.tobytes()) for x in reader.document(doc)] == [want[doc][2]] and reader.document(-5) == []
    raw = bytearray(open(files[0][0], "rb").read())
    import io

    import zstandard

    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True)
    assert whole.decompress(bytes(raw))
    raw[40] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        op5.Reader(io.BytesIO(bytes(raw))).frame(0)


def test_frames(tmp_path):
    """Several frames in one file; each document is read from its own."""
    with open(tmp_path / "x", "wb") as out:
        w = op5.Writer(out)
        w.add(np.arange(5), np.array([3, 1, 2, 4, 1]), np.arange(11))
        w.add(np.array([7, 7]), np.array([1, 2]), np.array([5, 6, 7]))
        w.close()
    with open(tmp_path / "x", "rb") as source:
        r = op5.Reader(source)
        assert len(r.frames) == 2 and r.index[1] == (7, 7, 11, 2)
        assert [x.tolist() for x in r.document(7)] == [[5], [6, 7]] and [x.tolist() for x in r.document(3)] == [[6, 7, 8, 9]]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(op8.TOKENIZER))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op8.token_counts(frame(spark, all_rows())).collect()}
    for i, t in all_rows():
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>&nbsp;three.<br>Four<p>Five &lt;six&gt;</article>
<div id="comments"><p>A reader says that this is the best of all the pages</p></div><form><p>Name</p></form><footer>&copy; x</footer>"""


def test_html():
    assert op7.main_text(PAGE) == "Head & line One two three. Four Five <six>"
    assert op7.main_text(None) == op7.main_text("") == "" and op7.main_text("just text &amp; more") == "just text & more"
    body = "This is the text of the page and it is in the middle of all the other things that are on it."
    loose = f'<div><a href="x">menu entry of links that is long enough to be seen as more than a short block</a></div><p>Short head</p><p>{body}</p><p>{body}</p><p>tail</p><div class="sidebar"><p>{body}</p></div>'
    assert op7.main_text(loose).startswith(("Short head", body)) and "menu" not in op7.main_text(loose) and op7.main_text(loose).count(body) == 2
    assert op7.main_text("<p>a < b</p><p title='x>y'>c") == "a < b c"


def test_html_names_are_evidence():
    prose = "This is the text of the page and it is in the middle of all the other things that are on it."
    page = lambda inner: f"<nav><a href=x>Home</a></nav><article><h1>Head</h1>{inner}<p>Tail</p></article><footer>c</footer>"
    for tag in ('<section class="related-work">', '<section id="login-issues">', '<div class="article-header">'):
        assert op7.main_text(page(f"{tag}<h2>Sub</h2><p>{prose}</p></section></div>")) == f"Head Sub {prose} Tail"
    for tag in ('<div class="comments-section">', '<div class="cookie-notice">', '<div class="share-buttons">', '<div id="ad-1">', '<div role="search">', "<div hidden>"):
        assert op7.main_text(page(f"{tag}<p>{prose}</p></div>")) == "Head Tail"


def test_html_loses_no_text_after_an_unclosed_tag():
    for tag in ("svg", "noscript", "object", "canvas", "select", "iframe", "textarea", "title", "template"):
        assert op7.main_text(f"<article><p>before</p><{tag}><p>after</p></article>") == "before after", tag
    assert op7.main_text("<p>one</p><!-- never closed <p>two</p>").startswith("one") and "two" in op7.main_text("<p>one</p><!-- never closed <p>two</p>")
    assert op7.main_text("<p>a<script>x()<p>b") == "a"


@pytest.mark.parametrize("part", ['<a b="', "<a b='x ", "<svg>", "<p x", "<!--", '<a ">" ', "<div>", "</div>", "<", "&amp"])
def test_html_takes_linear_time(part):
    import time

    begin = time.process_time()
    op7.main_text(part * (500_000 // len(part)))
    assert time.process_time() - begin < 5


def generated_page(r):
    """A page and its main text, block by block as it was put together."""
    words = ["the", "of", "and", "to", "in", "house", "river", "stone", "is", "a", "on", "was", "light", "with", "for"]
    said = lambda n: " ".join(r.choice(words) for _ in range(n))
    noise = lambda: r.choice(
        [f"<nav><ul><li><a href=a>{said(1)}</a></li></ul></nav>", f"<aside><p>{said(30)}</p></aside>", f'<div class="sidebar"><p>{said(30)}</p></div>', f'<form><p>{said(9)}</p><input></form>', f"<script>var x = '{said(4)}';</script>", f"<style>p {{}}</style>", f'<div class="cookie notice"><p>{said(20)}</p></div>', f"<footer>{said(5)}</footer>", f'<section id="comments"><p>{said(40)}</p></section>', "<!-- " + said(3) + " -->"]
    )
    main, html = [], []
    for _ in range(r.randint(1, 8)):
        kind = r.choice(["h2", "p", "p", "p", "li", "pre", "td"])
        text = said(r.randint(1, 6) if kind == "h2" else r.randint(2, 60))
        main.append(text)
        inner = text.replace(" house ", " <b>house</b> ").replace(" of ", " <a href=x>of</a>\n  ")
        html.append(f"<{kind}>{inner}" + (f"</{kind}>" if r.random() < 0.8 else ""))
        if r.random() < 0.3:
            html.append(noise())
    holder = r.choice(["article", "main"])
    page = "".join(noise() for _ in range(r.randint(0, 3))) + f"<{holder}>{''.join(html)}</{holder}>" + "".join(noise() for _ in range(r.randint(0, 3)))
    return f"<html><head><title>t</title></head><body>{page}</body></html>", " ".join(main)


def test_html_of_generated_pages():
    r = random.Random(12)
    for _ in range(400):
        page, main = generated_page(r)
        assert op7.main_text(page) == main


def test_html_frames(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (None, None, None, 6)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id or 0, r.n_chars) for r in op7.extracted(pages).collect())
    assert got == [(0, 0), (1, len("Head & line One two three. Four Five <six>"))]
