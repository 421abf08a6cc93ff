import random
import re

from pyspark.sql import functions as F

from corpus_catalog.functions import text as X
from corpus_catalog.functions.json_text import json_string

WORDS = re.compile(
    r"\b(token|secret|password|passwd|auth|bearer|credential|api[_-]?key|private[_-]?key|"
    r"secret[_-]?key|access[_-]?token)\b",
    re.I,
)


def redacted(text):
    out, changed = [], 0
    for line in text.split("\n"):
        new = line
        if WORDS.search(line):
            new = re.sub("\"[^\"\n]*\"|'[^'\n]*'", '"[REDACTED]"', line)
        changed += new != line
        out.append(new)
    return "\n".join(out), changed


def random_texts(n, seed):
    rng = random.Random(seed)
    pieces = ["token", "MY_TOKEN", "api-key", "secret", "=", '"', "'", "x", "ñ", " ", "\n", "\r",
              "\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", "é", "👍", "a'b", '"v"', "_", "Auth"]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(n)]


def test_redaction_and_line_count_agree_with_python(spark):
    texts = random_texts(3000, 1)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select("t", X.redact(t), X.redaction_count(t), X.line_count(t)).collect()
    for text, clean, changed, n in got:
        assert (clean, changed) == redacted(text)
        assert n == len(text.splitlines()), repr(text)


def test_decode_agrees_with_python(spark):
    rng = random.Random(2)
    blobs = [bytes(rng.choices([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x80, 0xFF, 0xED, 0xA0], k=6)) for _ in range(2000)]
    df = spark.createDataFrame([(bytearray(b),) for b in blobs], "b binary")
    for b, text, lossy in df.select("b", X.decode(F.col("b")), X.is_lossy(F.col("b"))).collect():
        assert text == bytes(b).decode("utf-8", "replace")
        try:
            bytes(b).decode("utf-8")
            assert not lossy
        except UnicodeDecodeError:
            assert lossy


def test_names(spark):
    names = ["a/b.TXT", ".env", "a.", "x/.env", "a.tar.gz", "..b", "noext", "d.x/y"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r[0]: (r[1], r[2]) for r in df.select("p", X.file_name(F.col("p")), X.extension(F.col("p"))).collect()}
    assert got == {
        "a/b.TXT": ("b.TXT", ".txt"), ".env": (".env", ""), "a.": ("a.", ""), "x/.env": (".env", ""),
        "a.tar.gz": ("a.tar.gz", ".gz"), "..b": ("..b", ".b"), "noext": ("noext", ""), "d.x/y": ("y", ""),
    }


def test_ancestors_and_order(spark):
    paths = ["a-b", "a/b", "a/b/c", "a", "a.x/z"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    up = {r[0]: r[1] for r in df.select("p", X.ancestor_dirs(F.col("p"))).collect()}
    assert up == {"a-b": [], "a/b": ["a"], "a/b/c": ["a", "a/b"], "a": [], "a.x/z": ["a.x"]}
    ordered = [r[0] for r in df.orderBy(X.order_key(F.col("p"))).collect()]
    assert ordered == sorted(paths, key=lambda p: p.split("/"))


def test_js_and_markdown(spark):
    js = (
        "import a from './x/y'\nimport {b,\nc} from 'pkg/z'\nimport  d from \"q\"\n"
        "export default function f1() {}\nexport const  c2 = 1\nexport\tclass K {}\nexportx function no() {}"
    )
    md = "x\n#\n\nLate\r\n# Title"
    df = spark.createDataFrame([(js, md)], "js string, md string")
    row = df.select(X.js_exports(F.col("js")), X.js_imports(F.col("js")), X.markdown_title(F.col("md"))).first()
    assert row[0] == re.findall(r"export\s+(?:default\s+)?(?:function|class|const|let|var)\s+(\w+)", js)
    assert row[1] == [i.split("/")[0] for i in re.findall(r"import\s+.*?from\s+[\"']([^\"']+)[\"']", js)]
    assert row[2] == re.search(r"^#\s+(.+)$", md, re.M).group(1)


def test_roles(spark):
    cases = {
        "tests/a.py": "test", "x/test/a": "test", "test_x": "test", "a_test.py": "test",
        "myconfig.py": "config", "requirements.txt": "docs", "Dockerfile": "config", ".env": "config",
        "main.py": "entrypoint", "app.js": "entrypoint", "a.scala": "library", "a.bin": "unknown",
        "pkg.json/x.rs": "library", "LICENSE": "docs",
    }
    df = spark.createDataFrame([(p, "") for p in cases] + [("guard.sh", "if __name__")], "p string, t string")
    got = {r[0]: r[1] for r in df.select("p", X.role(F.col("p"), F.col("t"))).collect()}
    assert got == {**cases, "guard.sh": "entrypoint"}


def test_private_key_headers(spark):
    head = "-----BEGIN {}-----"
    cases = {
        "RSA PRIVATE KEY": (True, True),
        "EC PRIVATE KEY": (True, True),
        "PRIVATE KEY": (False, True),
        "PGP PRIVATE KEY BLOCK": (True, True),
        "PUBLIC KEY": (False, False),
    }
    df = spark.createDataFrame([(k, ("é " + head.format(k)).encode()) for k in cases], "k string, c binary")
    c = F.col("c")
    got = {r[0]: (r[1], r[2]) for r in df.select("k", X.has_private_key(c), X.has_private_key(c, True)).collect()}
    assert got == cases


def test_binary_window(spark):
    df = spark.createDataFrame(
        [("in", b"a" * 8191 + b"\0"), ("out", b"a" * 8192 + b"\0"), ("none", b"")], "k string, c binary"
    )
    got = {r[0]: r[1] for r in df.select("k", X.is_binary(F.col("c"))).collect()}
    assert got == {"in": True, "out": False, "none": False}


def test_clip_and_cell(spark):
    df = spark.createDataFrame([("é" * 500,), ("é" * 501,), ("a" * 60,), ("a" * 61,)], "t string")
    got = [tuple(r) for r in df.select(X.clip(F.col("t")), X.cell(F.col("t"))).collect()]
    assert got[0][0] == "é" * 500
    assert got[1][0] == "é" * 497 + "..."
    assert got[2][1] == "a" * 60
    assert got[3][1] == "a" * 60 + "..."


def test_json_string_is_ascii_json(spark):
    import json

    texts = ["plain/a.py", 'q"b\\', "é👍\n\t\x01\x7f", "", "a b-[]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for text, literal in df.select("t", json_string(F.col("t"))).collect():
        assert literal == json.dumps(text)
