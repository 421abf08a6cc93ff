"""URL rules, periodic runs and fill-in-middle against plain versions of their rules, and on odd input."""

import hashlib
import random
import itertools
import re
import zlib
from re import _constants as RC, _parser as RP

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpus_catalog.llm import fill_middle as M, html_text as H, licenses as L, periodic_runs as P, quality as QL, queries as Q, url_rules as U

TEXTS = "doc_id long, text string, n long, runs int, output string, form string, id string"


def docs(spark, texts):
    """Documents with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, 2, "x", "y", "z") for i, t in texts], TEXTS)


def saved(spark, tmp_path, name, df):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- URL rules -------------------------------------------------------------------

URLS = [
    "http://A.Example.NET/en/x", None, "", "no-scheme.net/x", "http://u:p@x.com://b.net/", "ftp://x.net", "http://NET/", "://net/",
    "http://xnet/", "http://a.org/fr/\nq?x", "http://a.com/LOGIN", "http://a.com/x.exe?y", "http://a.com/x.EXE", "http://docs.casino.com/",
    "http://casino.com/docs/", "http://a.com/x?ſ=K/login|", "http://a.com/" + "y" * 70_000 + ".zip", "https://example.com/de", "http://b.example.net/en/",
    "http://b.example.net/EN/", "http://ads.a.com/", "http://loads.a.com/", "http://日本.net/ü", "http://a.com/viagra-x", "http://a.com/xviagra",
    "http://ads.a.com/", "x://bets", "http://free-bets.com?x", "http://free-betsy.com?x",
]


def pages(spark, urls):
    rows = [(None if n % 7 == 3 else n, u, "h", "p", "r", 1, "t") for n, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, rank int, token string")


def plain_verdict(url, rules):
    """All rules tried in turn."""
    host, path, seen = "", "", url or ""
    if "://" in seen:
        rest = seen.split("://", 1)[1]
        host, path, tail = re.match(r"(?s)([^/?#]*)([^?#]*)(.*)", rest).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        seen = f"://{host}{path}{tail}"
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), seen)
    hits = [(-rank, -len(r), r, v) for r, v, rank, cased, x, _ in rules if re.search(x.replace(r"\z", r"\Z"), seen if cased else lowered)]
    if not hits:
        return host, path, None, "allow", None
    rank, _, rule, verdict = min(hits)
    return host, path, rule if rank == -2 else None, verdict, None if rank == -2 else rule


@pytest.mark.parametrize("limit", [1 << 24, -1])
def test_urls_against_all_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(U, "BROADCAST_BYTES", limit)
    r = random.Random(4)
    bits = ["net", "casino", "example", "ads", "en", "login", "exe", "tag", "page", "docs", "x", "org", "fr", "calendar", "20", "month"]
    made = ["http://" + "".join(r.choice(bits) + r.choice("./-?=") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rules = U.default_rules()
    found = U.judge(pages(spark, URLS + made), U.rule_table(spark, rules)).collect()
    want = sorted((repr((None if n % 7 == 3 else n, *plain_verdict(u, rules)))) for n, u in enumerate(URLS + made))
    assert sorted(repr(tuple(row)) for row in found) == want


def test_urls_sql(spark):
    rules = U.default_rules()
    table = pages(spark, URLS)
    own = duckdb.connect()
    own.register("pages", pd.DataFrame({"page_id": pd.array([None if n % 7 == 3 else n for n in range(len(URLS))], dtype="Int64"), "url": URLS}))
    want = sorted(map(repr, own.sql(U.sql(rules)).fetchall()))
    assert sorted(repr(tuple(r)) for r in U.judge(table, U.rule_table(spark, rules)).collect()) == want


def test_contract_places(spark):
    rules = U.rule_table(spark, U.default_rules())
    found = {r.page_id: r for r in U.judge(pages(spark, URLS), rules).collect()}
    assert (found[0].rule, found[0].verdict) == ("example.net/en/", "allow")  # longer than net/
    assert (found[6].rule, found[6].verdict) == ("net/", "block")
    assert found[5].rule is None and found[5].path == ""
    assert found[8].rule is None  # xnet is no subdomain of net
    assert (found[19].rule, found[19].verdict) == ("net/", "block")  # paths keep their case
    assert (found[27].verdict, found[27].pattern) == ("block", "||free-bets^")
    assert (found[28].verdict, found[28].pattern) == ("allow", None)


def test_pattern_tokens_are_whole_tokens():
    tokens = {r[0]: r[5] for r in U.default_rules()}
    assert tokens["||free-bets^"] == ["free", "bets"]
    assert tokens["/viagra"] == []  # may go on in the URL
    assert tokens["/tag/*/page/"] == ["tag", "page"]
    assert tokens["/calendar/*/20"] == ["calendar"]
    assert tokens[".7z|"] == ["7z"]
    assert tokens["example.net/en/"] == ["example", "net", "en"]
    for bad in ("", "@@", "a|b", "||"):
        with pytest.raises(ValueError):
            U.pattern(bad)


def test_rarest_token_is_indexed(spark):
    urls = [f"http://common.com/{i}/free" for i in range(20)] + ["http://free-bets.com/"]
    rules = U.rule_table(spark, [U.pattern("||free-bets^"), U.pattern("/viagra"), U.pattern("||unseen^common^")])
    with U.Work(spark, "test") as work:
        seen = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("tokens", U._tokens(U._compared(F.col("url"))))
        index = {r.rule: r.token for r in U.indexed(work, rules, seen).collect()}
    assert index == {"||free-bets^": "bets", "/viagra": "", "||unseen^common^": "unseen"}


def test_urls_empty_tables(spark):
    rules = U.rule_table(spark, U.default_rules())
    assert U.judge(pages(spark, URLS).limit(0), rules).collect() == []
    assert {r.verdict for r in U.judge(pages(spark, URLS), rules.limit(0)).collect()} == {"allow"}


# --- periodic runs ------------------------------------------------------------------


def plain_runs(w, least, repeats):
    n, found = len(w), set()
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            run = w[start : i + q]
            if i > start and len(run) >= max(least, repeats * q):
                if not any(run[k:] == run[: len(run) - k] for k in range(1, q)):
                    found.add((start, len(run), q))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


words = st.lists(st.integers(0, 3), max_size=40)
periodic = st.tuples(words, st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(3, 9), words).map(lambda x: x[0] + x[1] * x[2] + x[3])


@settings(max_examples=400, deadline=None)
@given(st.one_of(words, periodic))
def test_runs_against_plain(w):
    n = len(w)
    lyndon = [next((j for j in range(i + 1, n) if w[j:] < w[i:]), n) - i for i in range(n)]
    if n:
        assert P.lyndon_lengths(w).tolist() == lyndon
        assert [tuple(r) for r in P.runs_of(np.array(w)).tolist()] == plain_runs(w, 2, 2)
    text = [b"w%d" % x for x in w]
    assert P.text_runs(text) == plain_runs(text, P.MIN_LENGTH, P.MIN_REPEATS)


def plain_row(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(w, 6, 4)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    s, length, q = (best[1], -best[0], best[2]) if best else (None, None, None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return i, len(runs), s, length, q, 1000 * length // q if best else None, sha(lines), sha(kept)


def test_runs_query_against_plain(spark, tmp_path):
    r = random.Random(3)
    texts = [(None, "a a a a a a a"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "a b " * 9), (5, "a b " * 9), (6, "é 日 🙂 " * 5)]
    texts += [(100 + k, " ".join(r.choice("a b c dd e F f".split()) for _ in range(r.randint(0, 90)))) for k in range(150)]
    texts += [(1000, " ".join(f"w{r.randrange(300)}" for _ in range(3000)) + " x y" * 50 + "\x0bend")]
    found = Q.op12_periodic_runs(spark, saved(spark, tmp_path, "documents", docs(spark, texts))).drop("n_words").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(plain_row(i, t)) for i, t in texts)


def test_long_text_of_one_period():
    unit = [b"w%d" % k for k in range(700)]
    text = [b"a", b"b"] + unit * 120 + [b"c"] * 50_000
    assert P.text_runs(text) == [(2, 84_000, 700), (84_002, 50_000, 1)]


def test_runs_empty_table(spark):
    assert P.digest(P.periodic_runs(docs(spark, []))).collect() == []


# --- fill-in-middle -------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300), st.integers(0, 126))
def test_rank_index_is_exact(gaps, error):
    values = np.cumsum(gaps)
    index = M.RankIndex(values, error)
    assert index[np.arange(len(values))].tolist() == values.tolist()
    assert np.abs(index.residual).max() <= error + 1


def test_rank_index_segments():
    even = M.RankIndex(np.arange(0, 5_000_000, 50))
    assert len(even.first) == 1 and not even.residual.any()
    bent = M.RankIndex(np.concatenate([np.arange(0, 100_000, 10), np.arange(100_000, 9_000_000, 900)]))
    assert len(bent.first) < 5
    with pytest.raises(ValueError):
        M.RankIndex(np.arange(3), 127)


def plain_cut(i, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return i, n, "plain", None, None, text, text
    form = "spm" if h[3] % 100 < 50 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return i, n, form, len(prefix), len(middle), output, text


def cut_texts():
    r = random.Random(5)
    odd = [(None, "a\nb\nc"), (None, None), (1, None), (2, ""), (3, "\n"), (4, "\n\n\nx"), (5, "a <M> b\nc"), (6, "<P"), (7, "S>\n<S\n>"), (8, "x"), (8, "x")]
    odd += [(9, "é\n日本\r\n🙂🙂\u2028\x85z\n" * 40), (10, "long " * 200_000 + "\nend"), (11, "<" * 9 + "\n" + ">" * 9)]
    return odd + [(100 + k, "".join(r.choice("ab\n<>é🙂PSM ") for _ in range(r.randint(0, 60)))) for k in range(300)]


def test_cuts_against_plain(spark):
    texts = cut_texts()
    found = M.fill_middle(docs(spark, texts)).withColumn("restored", M.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(plain_cut(i, t)) for i, t in texts)


def test_cuts_sql(spark, tmp_path):
    texts = cut_texts()
    found = Q.op13_fill_middle(spark, saved(spark, tmp_path, "documents", docs(spark, texts))).collect()
    own = duckdb.connect()
    own.register("documents", pd.DataFrame({"doc_id": pd.array([i for i, _ in texts], dtype="Int64"), "text": [t for _, t in texts]}))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, own.sql(M.SQL).fetchall()))


def test_cut_rates_and_empty_table(spark):
    table = docs(spark, [(k, f"a{k}\nb\nc\n") for k in range(400)])
    assert M.fill_middle(table.limit(0)).collect() == []
    assert {r.form for r in M.fill_middle(table, rate=0).collect()} == {"plain"}
    assert {r.form for r in M.fill_middle(table, spm=0).collect()} == {"psm"}
    half = sum(r.form == "plain" for r in M.fill_middle(table, rate=50).collect())
    assert 150 < half < 250


# --- licence rules ------------------------------------------------------------------


def samples(expression):
    """Texts that an expression matches: every alternative, each optional part with and without."""

    def of(parts):
        found = [""]
        for op, value in parts:
            if op is RC.LITERAL:
                some = [chr(value)]
            elif op is RC.ANY:
                some = ["x"]
            elif op is RC.IN:
                first = value[0]
                some = ["w" if first[0] is RC.CATEGORY else chr(first[1][0] if first[0] is RC.RANGE else first[1])]
            elif op is RC.BRANCH:
                some = [t for branch in value[1] for t in of(branch)]
            elif op is RC.SUBPATTERN:
                some = of(value[3])
            elif op in (RC.MAX_REPEAT, RC.MIN_REPEAT):
                low, high, inner = value
                one = of(inner)
                some = [t * low for t in one] if low else ["", *one]
                some += [t * 2 for t in one] if high > 1 and low < 2 else []
            else:
                raise ValueError(op)
            found = [a + b for a, b in itertools.islice(itertools.product(found, some), 400)]
        return found

    return list(dict.fromkeys(of(RP.parse(expression))))


RULES = [(k, e, l, p, samples(e)) for k, e, l, p in L.rules()]


def test_every_match_of_a_rule_holds_its_keyword():
    for keyword, expression, label, _, texts in RULES:
        for text in texts:
            assert re.fullmatch(expression, text), (expression, text)
            assert keyword in text.split(" "), (keyword, label, text)
            assert text == " ".join(re.findall("[a-z0-9]+", text)), text


def test_rules_are_written_by_hand():
    families = {(e, l) for _, e, l, _ in L._FAMILIES}
    assert len({e for _, e, _, _ in L._OTHERS} | families) >= 190 and len(L.rules()) > 400


def plain_labels(text):
    """Every rule on the whole text, every detection compared with every other."""
    body = f" {' '.join(re.findall('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', re.sub('[A-Z]', lambda m: m[0].lower(), text or '')))} "
    found = set()
    for _, expression, label, priority, _ in RULES:
        for m in re.finditer(rf"(?<= )(?:{expression})(?= )", body):
            start = body[: m.start()].count(" ") - 1
            found.add((label, priority, start, start + m[0].count(" ")))
    kept = set()
    for label, p, a, b in found:
        inside = [(q, x, y) for _, q, x, y in found if x <= a and b <= y and (q > p or q == p and y - x > b - a)]
        if not inside:
            kept.add(label)
    flat = body.replace(" ", "  ")
    return kept | {l for phrase, l in L.BASE.items() if f" {phrase.replace(' ', '  ')} " in flat}


def test_labels_against_a_plain_scan(spark):
    r = random.Random(11)
    filler = "the of license under public terms x copy mit gnu version 2 0 or later all rights and by".split()
    texts = [(n, rule[4][-1] if n % 2 else rule[4][0]) for n, rule in enumerate(RULES)]
    for n in range(300):
        parts = [r.choice(r.choice(RULES)[4]) if r.random() < 0.4 else r.choice(filler) for _ in range(r.randint(1, 12))]
        texts.append((1000 + n, r.choice([" ", ", ", "\n", "-"]).join(parts)))
    texts += [(5000, None), (5001, ""), (None, "GPLv3"), (5002, "GPLv3 " * 3000)]
    found = {r.doc_id: set(filter(None, r.labels.split(","))) for r in L.scan(docs(spark, texts)).collect()}
    wrong = [(t, found[i], plain_labels(t)) for i, t in texts if found[i] != plain_labels(t)]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize(
    "text, label",
    [
        ("GPLv3", "gpl-3"), ("LGPLv2.1+", "lgpl-2.1"), ("It is released to the public domain.", "public-domain"), ("dedicated to the public domain", "public-domain"),
        ("placed in the public domain", "public-domain"), ("Licenced under the Foo licence", "licensed"), ("Q Public License", "qpl"), ("may not be copied", "no-redistribution"),
        ("may not be redistributed", "no-redistribution"), ("MIT licensed", "mit"), ("BSD licensed", "bsd"), ("Beer-ware license", "beerware"), ("PSF License", "psf"),
        ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("SPDX-License-Identifier: MIT", "mit"),
        (f"Neither the name of {'x' * 90} nor the names of its contributors", "bsd-3-clause"),
    ],
)
def test_phrases_that_had_no_label(text, label):
    assert label in plain_labels(text)


@pytest.mark.parametrize("text", ["the quick license of mitten", "GPLv", "submit license", "public domains", "mpl3000", "spdx license", "reserved rights", "bsdx license"])
def test_near_misses(text):
    assert plain_labels(text) == set()


# --- pages that once lost their text ---------------------------------------------------

PROSE = "A sentence of ordinary prose runs on for a while, and says what it has to say. Another one follows it here."
BODY = f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p>"
NAV, FOOT = "<nav><a href=/>Home</a> <a href=/b>About</a></nav>", "<footer><p>Copyright 2020 Somebody</p></footer>"
WANTED = "\n".join(["Title", PROSE, PROSE, PROSE])


@pytest.fixture(scope="module")
def model():
    return H.fit([])


@pytest.mark.parametrize(
    "page",
    [
        f'{NAV}<article class="overflow-hidden">{BODY}</article>{FOOT}',
        f'{NAV}<article class="with-sidebar" style="overflow:hidden">{BODY}</article>{FOOT}',
        f'{NAV}<article class="post tag-news">{BODY}</article>{FOOT}',
        f'{NAV}<article class="page-print">{BODY}</article>{FOOT}',
        f'<div class="has-sidebar no-comments">{NAV}<main>{BODY}</main>{FOOT}</div>',
        f'<form id="all" action="/">{NAV}<article>{BODY}</article>{FOOT}</form>',
        f'{NAV}<article data-x="{"a>b" * 1500}">{BODY}</article>{FOOT}',
        f'{NAV}<article {" ".join(f"a{k}=1" for k in range(600))}>{BODY}</article>{FOOT}',
        f"{NAV}<article title='it is \"so\" > here'>{BODY}</article>{FOOT}",
        f'{NAV}<article>{BODY}<p hidden>{PROSE}</p><div style="display : none"><p>{PROSE}</p></div><p aria-hidden=true>{PROSE}</p></article>{FOOT}',
        f'{NAV}<article>{BODY}</article><form class="signup"><p>Give us your address</p></form>{FOOT}',
    ],
)
def test_containers_names_and_attributes(model, page):
    assert model.text(f"<html><body>{page}</body></html>") == WANTED


def test_names_of_boilerplate():
    assert all(H.noisy(n) for n in ("sidebar", "site-footer", "main_nav", "post comments", "cookie-notice", "print", "entry-tags"))
    assert not any(H.noisy(n) for n in ("", "with-sidebar", "tag-news", "page-print", "overflow-hidden", "has_comments", "brand", "headers-x", "main"))


def test_attributes():
    found = H.attributes(""" CLASS='a b' id=x data-q="1 > 2" hidden title = "it's" class=z""")
    assert found == {"class": "a b", "id": "x", "data-q": "1 > 2", "hidden": "", "title": "it's"}


def test_broken_markup_ends():
    for page in ("<a b='" * 20_000, '<a b="<' * 20_000 + ">", "<" * 50_000, "<p " * 50_000, "<p a=\"" + "x" * 100_000):
        H.parse(page)


def test_training_pages_do_not_depend_on_files(spark):
    rows = [(k, f"u{k}", f"<body>{NAV}<article>{BODY}<p>Number {k} of the pages</p></article>{FOOT}</body>") for k in range(60)]
    models = []
    for n in (1, 3, 7):
        table = spark.createDataFrame(random.Random(n).sample(rows, 60), "page_id long, url string, html string").repartition(n)
        models.append(H.train(table, most=20))
    assert all((m.weights == models[0].weights).all() and m.pairs == models[0].pairs for m in models)



# --- robust estimate against plain numpy ------------------------------------------------


def quantile(values, p):
    return np.sort(values)[max(0, int(np.ceil(p * len(values))) - 1)]


def plain_estimate(x):
    """Mean and factor of one group by the same steps, on whole arrays."""
    p = x.shape[1]
    middle = np.array([quantile(x[:, i], 0.5) for i in range(p)])
    widths = [
        [(quantile(x[:, i], 0.75) - quantile(x[:, i], 0.25)) / 1.349 for i in range(p)],
        [quantile(np.abs(x[:, i] - middle[i]), 0.5) / 0.6745 for i in range(p)],
    ]
    now = [(middle, np.diag(1 / np.maximum(w, QL.FLOOR))) for w in widths]
    best = [(np.inf, None, None)] * 2
    while True:
        fell, following = False, []
        for k, (m, w) in enumerate(now):
            d = (((x - m) @ w.T) ** 2).sum(1)
            core = x[d <= quantile(d, QL.CORE)]
            mean, scatter = core.mean(0), np.cov(core.T, bias=True)
            free = sum(scatter[i, i] * max(QL.CONSISTENT) > QL.FLOOR[i] ** 2 for i in range(p))
            scatter = scatter * QL.CONSISTENT[free]
            low = np.zeros((p, p))
            for i in range(p):
                for j in range(i + 1):
                    rest = scatter[i, j] - low[i, :j] @ low[j, :j]
                    low[i, j] = np.sqrt(max(rest, QL.FLOOR[i] ** 2)) if i == j else rest / low[j, j]
            det = 2 * np.log(np.diag(low)).sum()
            fell |= best[k][0] - det > QL.FALL
            best[k] = min(best[k], (det, mean, np.linalg.inv(low)), key=lambda b: b[0])
            following.append((mean, np.linalg.inv(low)))
        now = following
        if not fell:
            return min(best, key=lambda b: b[0])


def test_robust_distances_equal_plain_numpy(spark):
    """Correlated rows, a third of them junk, ties and repeated rows; a statistic without scatter."""
    r = np.random.default_rng(3)
    n, p = 500, len(QL.STATS)
    x = r.normal(size=(n, p)) @ np.diag([0.3, 0.5, 0.4, 0.6, 0.5])
    x[:, 1] += 0.5 * x[:, 0]
    x[:160] += [0, 7, 0, 6, 0]
    x[:, 2] = 0.0
    x[200:230] = x[200]
    x[300:340, 4] = 0.25
    rows = spark.createDataFrame([("en", "s", i, *map(float, v)) for i, v in enumerate(x)], "lang string, source string, i long, " + ", ".join(f"{s} double" for s in QL.STATS))
    with QL.Work(spark, "test") as work:
        found = {row.i: row.distance for row in QL.outliers(work, rows).collect()}
    _, m, w = plain_estimate(x)
    want = (((x - m) @ w.T) ** 2).sum(1)
    assert np.allclose([found[i] for i in range(n)], want, rtol=1e-6, atol=1e-9)
    assert (want[:160] > QL.LIMIT).all() and (want[160:] < QL.LIMIT).mean() > 0.98
    assert len({found[i] for i in range(200, 230)}) == 1
