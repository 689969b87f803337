import base64
import collections
import hashlib
import json
import re

import pytest

from cohortia.llm import html, secrets
from tests.llm import helpers as H

PATTERNS = [("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
            ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def base_spans(t):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in p.finditer(t or "") if ok(m)]
    return [f"{PATTERNS[k][0]}:{a}:{z}" for a, k, z in sorted(found)]


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def number(n, size):
    return der(2, b"\x01" + n.to_bytes(size, "big"))


RSA = der(0x30, der(2, b"\0") + b"".join(number(i, 40) for i in range(8)))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, RSA))
SSH = b"openssh-key-v1\0" + b"\0\0\0\4none" * 2 + b"\0\0\0\0" + b"\0\0\0\1" + b"x" * 40


def b64(x):
    return base64.b64encode(x).decode()


def url(x):
    return base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")


TEXTS = ["token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" x", "PassWord: abcde Secret=abcdef 'api_key' : \"Zz9+/_.=-\"", "secret: token=abcdef",
         "secret:token:abcdefgh", "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " xAKIAAKIA" + "9" * 12, "é中 token=abcdef " + "f" * 24 + "g" + "0" * 23,
         "toKen=abcdefg ſecret=abcdefg apikey=" + "a" * 30, "", "plain words only"]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    assert [f"{k}:{a}:{z}" for k, a, z in secrets.find(text) if k in secrets.BASE] == base_spans(text)


def kinds(text):
    return [text[a:z] for k, a, z in secrets.find(text) if k in ("jwt", "pem", "key")]


def test_only_what_parses_is_confirmed():
    jwt = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': '1'})}.c2lnbmF0dXJl"
    assert kinds(f"auth {jwt}, done") == [jwt]
    assert kinds(f"auth {url({'typ': 'JWT'})}.{url({'sub': '1'})}.c2lnbmF0dXJl") == []
    assert kinds("eyJub3QganNvbiBhdCBhbGw.aaaa.bbbb") == []
    for key in (RSA, PKCS8, SSH, der(0x30, der(2, b"\1") + der(4, b"k" * 32))):
        assert kinds(f"x {b64(key)} y") == [b64(key)]
        assert kinds(f"x {key.hex()} y") == [key.hex()]
        body = "\n".join(b64(key)[i:i + 64] for i in range(0, len(b64(key)), 64))
        pem = f"-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----"
        assert pem in kinds(f"a\n{pem}\nb")
    assert kinds(b64(RSA[:-1] + b"\0\0")) == [] and kinds(b64(RSA[:60])) == []
    assert kinds(b64(der(0x30, der(2, b"\0") + der(4, b"x")) + b"z" * 40)) == []
    assert kinds("A" * 400) == [] and kinds("30" * 40) == []
    assert kinds(f"-----BEGIN PRIVATE KEY-----\n{b64(b'nothing of note' * 5)}\n-----END PRIVATE KEY-----") == []


def wrapped(x, width=64, end="\n"):
    return end.join(b64(x)[i:i + width] for i in range(0, len(b64(x)), width))


SEALED = der(0x30, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d") + der(0x30, der(0x30, der(6, b"\x2a") + der(5, b"")))) + der(4, RSA[:-1]))


@pytest.mark.parametrize("end", ["\\n", "\\\\n", "\\r\\n", "\\u000a", "\n", "\\n\" +\n  \"", "\\n' \\\n '"])
def test_pem_with_written_line_ends(end):
    for key, name in ((RSA, "RSA PRIVATE KEY"), (PKCS8, "PRIVATE KEY"), (SSH, "OPENSSH PRIVATE KEY"), (SEALED, "ENCRYPTED PRIVATE KEY")):
        pem = f"-----BEGIN {name}-----{end}{wrapped(key, 64, end)}{end}-----END {name}-----"
        assert pem in kinds('{"private_key": "' + pem + '\\n", "x": 1}')
    assert kinds(json.dumps({"k": b64(b"nothing of note" * 9)})) == []
    slashed = b64(bytes(PKCS8)).replace("/", "\\/").replace("+", "\\u002b")
    assert kinds(f"-----BEGIN PRIVATE KEY-----\\n{slashed}\\n-----END PRIVATE KEY-----") != []


def test_bare_keys_on_several_lines_and_base64_of_pem():
    for key in (RSA, PKCS8, SEALED, SSH):
        for width in (40, 64, 76):
            for end in ("\n", "\r\n", "\n    ", "\\n"):
                body = wrapped(key, width, end)
                assert kinds(f"the key:\n{body}\n\nthe end") == [body]
                assert kinds(f'"key": "\\n{body}\\n"') == [body]
        assert kinds(f"{wrapped(key)}\n") == [wrapped(key)]
        pem = f"-----BEGIN CERTIFICATE-----\nMAA=\n-----END CERTIFICATE-----\n-----BEGIN PRIVATE KEY-----\n{wrapped(key)}\n-----END PRIVATE KEY-----\n"
        for text in (b64(pem.encode()), wrapped(pem.encode(), 76)):
            assert kinds(f"data: {text} .") == [text]
    for key in (RSA, PKCS8, SEALED):
        assert kinds(f"{wrapped(key)}\nwords after it") == [wrapped(key)]
    assert kinds(b64(SEALED)) == [b64(SEALED)] and kinds(b64(SEALED[:-1] + b"\0\0")) == []
    digest = der(0x30, der(0x30, der(6, b"\x60\x86") + der(5, b"")) + der(4, b"d" * 64))
    assert kinds(b64(digest)) == [] and kinds(wrapped(b"-----BEGIN PRIVATE KEY-----\nAAAA\n-----END PRIVATE KEY-----\n" * 3)) == []


def test_scan_and_redact(spark, sf_dir):
    rows = H.awkward() + [(1000 + i, t, None, None, 0) for i, t in enumerate(TEXTS)] + [r for r in H.documents(sf_dir) if r[0] > 20]
    found = secrets.scan(H.clashing(H.table(spark, rows)), keep=["doc_id", "text"])
    got = found.select("doc_id", "text", secrets.joined(secrets.base_spans()).alias("base"), secrets.redact(found["text"], found["spans"]).alias("clean")).collect()
    assert collections.Counter((r.doc_id, r.base) for r in got) == collections.Counter((r[0], ",".join(base_spans(r[1]))) for r in rows)
    for r in got:
        assert base_spans(r.clean) == [] and (r.base or r.clean == (r.text or ""))
    clean = {r.text: r.clean for r in got}
    assert clean[TEXTS[0]] == "[SECRET]\" x" and clean[TEXTS[2]] == "[SECRET]"
    assert secrets.scan(H.table(spark, []), keep=["doc_id"]).count() == 0


def test_query_digest(spark, sf_dir):
    from cohortia.llm import queries

    texts = {r[0]: r[1] for r in H.documents(sf_dir)}
    for r in queries.QUERIES["op10_structural_secrets"](spark, sf_dir).collect():
        base = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b.startswith(k) for b in base) for k in secrets.BASE)


PAGES = {
    "": "", "just text": "just text", "<!-- never closed <p>x": "", "<p>a<script>var t='</p>'</script> b": "a b",
    "<body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>T &amp; U</h1><p><b>One.<br><p>Two,\n  three &lt;ok&gt;</p></article><footer>f</footer>": "T & U\nOne.\nTwo, three <ok>",
    "<div class='sidebar'><p>x, y, z</p></div><div id=main><section><p>Hello &#39;a,b</p></section><section><h2>T</h2>plain <ul><li>one<li>two</ul></section></div>"
    "<div class='reader-comments'><p>bad, worse</p></div><form><p>f</p></form>": "Hello 'a,b\nT\nplain\none\ntwo",
    "<header><h1>Site</h1></header><main><p>Body text here.</p><aside><p>side</p></aside><div class='cookie-notice'>c</div><div hidden>h</div></main>": "Body text here.",
    "<table><tr><td><p>Long cell text, with commas, and more of it, so that it counts for something.</td><td class=ad>ad</td></tr></table>":
        "Long cell text, with commas, and more of it, so that it counts for something.",
    "<div><p>First paragraph, of some length, in a plain page.</p></div><div><p>Second one, of a similar length, beside it.</p></div><div class=menu><a href=a>a</a></div>":
        "First paragraph, of some length, in a plain page.\nSecond one, of a similar length, beside it.",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert html.main_text(page) == PAGES[page]


def test_nothing_of_the_article_is_dropped():
    long = "Some text of the article, of a fair length, with commas, and more."
    assert html.main_text(f"<article><p>{long}</p><ul><li><a href=a>Source one</a><li><a href=b>Source two</a></ul></article>") == f"{long}\nSource one\nSource two"
    assert html.main_text(f"<section><div class='text'><p>{long}</p></div><div class='text'><p>{long} Again.</p></div></section>") == f"{long}\n{long} Again."
    for odd in ("<script>var s='<!--'</script>", "<style><!-- a {}</style>", "<p title='<!--'></p>"):
        assert html.main_text(f"<div>{odd}<p>{long}</p></div>") == long
    assert html.main_text(f"<div><p>{long}</p></div><!-- never closed <p>x") == long


def test_odd_markup_ends():
    assert html.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert html.main_text("</p></b></div><p>x</i>") == "x"


def test_extract_matches_articles(spark, sf_dir):
    import html as entities

    import pyarrow.parquet as pq

    rows = pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()
    df = spark.createDataFrame([(r["page_id"], r["url"], r["html"], "x") for r in rows] + [(None, None, None, None), (-1, "u", "", "x")] * 2,
                               "page_id long, url string, html string, text string")
    got = html.extract(df, keep=["page_id", "url"]).collect()
    want = {}
    for r in rows:
        parts = [entities.unescape(re.sub(r"<[^>]*>", " ", x)) for x in re.split(r"</?(?:p|h1)>", re.search(r"(?s)<article>(.*)</article>", r["html"])[1])]
        want[r["page_id"]] = "\n".join(x for x in (re.sub(r"\s+", " ", x).strip() for x in parts) if x)
    assert len(got) == len(rows) + 4
    for r in got:
        assert r.n_chars == len(r.text) and r.text == want.get(r.page_id, "")
    assert html.extract(df.limit(0), keep=["page_id"]).count() == 0
