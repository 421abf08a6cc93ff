"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame functions only.

Every rule is a regular expression together with the literal tokens (runs of ASCII letters and
digits) that any URL it matches must hold whole. A rule is indexed under the one of them that the fewest
URLs of the table hold. A URL's own tokens fetch its candidate rules, and only those
run their expressions on it. Rules without such a token are candidates of every URL.

Two kinds of rules. A *place* is a host and the beginning of a path; it fits the host and all subdomains. A
*pattern* is compared with the lower-cased URL from ``://host`` on:

    ||x     x begins the host or one of its labels
    ^       any character but an ASCII letter or digit, or the end
    *       anything
    x|      x ends the URL
    @@x     an exception: x is allowed

Of the rules that match, a place outranks patterns and an exception other patterns; then the longest wins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpus_catalog.llm.common import LOWER, UPPER, Work, lower_ascii

#: Rules, and judged URLs, up to this size are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: The places to judge, as verdict and place.
PLACES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: Patterns for web crawls: what is no text, or is not wanted in training data.
PATTERNS = """
||ad^ ||ads^ ||adserver^ ||adservice^ ||adsystem^ ||adtech^ ||adclick^ ||adimg^ ||banner^ ||banners^ ||doubleclick^ ||popads^ ||popunder^
||sponsored^ ||syndication^ ||clickserve^ /adserver/ /ads/ /adview^ /adclick^ /banners/ /sponsored/ ^ad_unit= ^adslot= ^popunder^
||track^ ||tracker^ ||tracking^ ||analytics^ ||beacon^ ||metrics^ ||pixel^ ||telemetry^ ||stats^ ||counter^ /pixel.gif /beacon.js /collect?v= /track.php
||casino^ ||casinos^ ||poker^ ||slots^ ||roulette^ ||jackpot^ ||betting^ ||bets^ ||bet^ ||sportsbook^ ||free-bets^ ||free-spins^ ||online-casino^ ||lottery^
/casino/ /casino-bonus /free-spins /sportsbook/ /poker/
||adult^ ||porn^ ||xxx^ ||sex^ ||escort^ ||escorts^ ||camgirls^ ||hentai^ ||nsfw^ /porn/ /xxx/ /nsfw/ /escorts/
||pills^ ||cheap-pills^ ||cheap-meds^ ||pharmacy-online^ ||online-pharmacy^ ||viagra^ ||cialis^ /viagra /cialis /cheap-pills
||spam^ ||linkfarm^ ||link-farm^ ||seo-links^ ||buy-backlinks^ ||replica-watches^ ||essay-writing^ ||payday-loans^ ||free-iphone^ /buy-backlinks /payday-loan
||phishing^ ||malware^ ||warez^ ||crackz^ ||keygen^ ||serialz^ ||torrent^ ||torrents^ /warez/ /keygen/ /torrent/ /crack-download
/login? /login| /logout? /logout| /signin? /signin| /signup? /signup| /register| /wp-login.php /wp-admin/ /password-reset /oauth/authorize
/cart? /cart| /cart/add /add-to-cart /checkout? /checkout| /checkout/ /basket| /wishlist? /wishlist| ^add-to-cart=
/search?q= /search?query= /?s= /tag/*/page/ /calendar?month= /calendar/*/20 ^sessionid= ^phpsessid= ^jsessionid= ^replytocom= ^share= ^print=
/feed/rss| /rss.xml| /atom.xml| /sitemap.xml| /xmlrpc.php /trackback/| /wp-json/ /cgi-bin/ /.git/ /.env|
.exe| .msi| .dmg| .apk| .iso| .zip| .rar| .7z| .tar| .gz| .jar| .jpg| .jpeg| .png| .gif| .webp| .svg| .ico| .mp3| .mp4| .avi| .mkv| .mov| .wav| .css| .js| .woff| .woff2| .ttf|
@@||docs^ @@||wiki^ @@||developer^ @@/license.txt| @@/robots.txt| @@/docs/ @@/wiki/ @@/help/search?q=
""".split()

_ANCHOR = r"^://(?:[^/?#]*\.)?"
Rule = tuple[str, str, int, bool, str, list[str]]


def _quoted(text: str) -> str:
    """``text`` as an expression that both Java and RE2 read."""
    return re.sub(r"[^A-Za-z0-9_\u0080-\U0010FFFF]", lambda m: "\\" + m[0], text)


def _lowered(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def place(verdict: str, spec: str) -> Rule:
    """A rule ``host/path`` as ``(rule, verdict, rank, cased, regex, tokens)``."""
    host, slash, path = spec.partition("/")
    if not host or not slash:
        raise ValueError(f"not a host and a path: {spec!r}")
    host, path = _lowered(host), slash + path
    last = re.search(r"[A-Za-z0-9]*\Z", path).start()  # may go on in the URL
    tokens = re.findall("[a-z0-9]+", host + _lowered(path[:last]))
    return spec, verdict, 2, True, _ANCHOR + _quoted(host + path), tokens


def pattern(spec: str) -> Rule:
    """A pattern as ``(rule, verdict, rank, cased, regex, tokens)``."""
    body = _lowered(spec.removeprefix("@@"))
    at_label, at_end = body.startswith("||"), body.endswith("|") and body != "||"
    body = body.removeprefix("||")
    body = body[:-1] if at_end else body
    if not body or "|" in body:
        raise ValueError(f"not a pattern: {spec!r}")
    parts = [r"(?s:.*)" if c == "*" else r"(?:[^a-z0-9]|\z)" if c == "^" else _quoted(c) for c in body]
    regex = (_ANCHOR if at_label else "") + "".join(parts) + (r"\z" if at_end else "")
    # A literal is a whole token of the URL only if something other than a letter or digit must be beside it.
    framed = ("/" if at_label else "*") + body + ("/" if at_end else "*")
    tokens = re.findall(r"(?<=[^*a-z0-9])[a-z0-9]+(?=[^*a-z0-9])", framed)
    return spec, "allow" if spec.startswith("@@") else "block", int(spec.startswith("@@")), False, regex, tokens


def default_rules() -> list[Rule]:
    return [place(*p) for p in PLACES] + [pattern(p) for p in dict.fromkeys(PATTERNS)]


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """``rule, verdict, rank, cased, regex, tokens`` of written rules; longer lists can be read from a table of these columns."""
    rows = F.array(
        *(
            F.struct(
                F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(rank).alias("rank"), F.lit(cased).alias("cased"),
                F.lit(regex).alias("regex"), F.array(*map(F.lit, tokens)).cast("array<string>").alias("tokens"),
            )
            for rule, verdict, rank, cased, regex, tokens in rules
        )
    )
    return spark.range(1).select(F.inline(rows))


def _host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased in A-Z; empty without ``://``."""
    return lower_ascii(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _path(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _compared(url: Column) -> Column:
    """What expressions see: ``://``, the host in lower case, and the rest; without ``://`` the URL itself."""
    rest = F.regexp_extract(_after(url), r"(?s)^[^/?#]*(.*)", 1)
    return F.when(url.contains("://"), F.concat(F.lit("://"), _host(url), rest)).otherwise(url)


def _tokens(compared: Column) -> Column:
    """A URL's distinct tokens, and the empty one of the rules that have none."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(lower_ascii(compared), F.lit("([a-z0-9]+)"))))


def _few(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("merge")


def indexed(work: Work, rules: DataFrame, urls: DataFrame) -> DataFrame:
    """``rules`` with ``token``: of each rule's tokens the one in the fewest of ``urls (tokens)``, the first of several; else empty."""
    size = int(rules.agg(F.coalesce(F.sum(F.size("tokens") * 16), F.lit(0))).first()[0])
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = work.store(
        urls.select(F.explode("tokens").alias("token")).join(_few(wanted, size), "token").groupBy("token").agg(F.count("*").alias("n")),
        "token-counts",
    )
    own = rules.select("rule", "regex", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = own.groupBy("rule", "regex").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))
    return work.store(
        rules.join(rarest, ["rule", "regex"], "left").withColumn("token", F.coalesce("token", F.lit(""))), "index"
    )


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern`` of every row: the place or else the pattern that decides, if any.

    Each distinct URL is judged once. A URL that nothing matches is allowed, as are null and empty ones. Null ids and repeated rows are
    judged like others; of equal rules and of equally long ones the first by name decides, so the order
    of the rules doesn't count. URLs of any length are compared whole. An empty table, of pages or
    of rules, gives a result too; other columns aren't read.
    """
    url = F.col(url_col).cast("string")
    own = pages.select(F.col(id_col).alias("page_id"), url.alias("url"))
    with Work(pages.sparkSession, "urls") as work:
        distinct = work.store(own.select("url").filter("url is not null").distinct(), "distinct")
        urls = distinct.select("url", _compared(F.col("url")).alias("t")).withColumn("tokens", _tokens(F.col("t")))
        rules = work.store(rules.select("rule", "verdict", "rank", "cased", "regex", "tokens"), "rules")
        index = indexed(work, rules, urls)
        size = int(index.agg(F.coalesce(F.sum(F.length("rule") + F.length("regex") + 64), F.lit(0))).first()[0])
        candidates = urls.select("url", "t", F.explode("tokens").alias("token")).join(_few(index.drop("tokens"), size), "token")
        matched = candidates.filter(F.rlike(F.when(F.col("cased"), F.col("t")).otherwise(lower_ascii(F.col("t"))), F.col("regex")))
        best = F.min_by(F.struct("rule", "verdict", "rank"), F.struct(-F.col("rank"), -F.length("rule"), "rule", "verdict"))
        hits = work.keep(matched.groupBy("url").agg(best.alias("best")), "hits")
    size = int(hits.agg(F.coalesce(F.sum(F.length("url") + F.length("best.rule") + 64), F.lit(0))).first()[0])
    known = F.coalesce(F.col("url"), F.lit(""))
    return own.join(_few(hits, size), "url", "left").select(
        "page_id", _host(known).alias("host"), _path(known).alias("path"),
        F.when(F.col("best.rank") == 2, F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("best.rank") < 2, F.col("best.rule")).alias("pattern"),
    )


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(rules: list[Rule]) -> str:
    """The rows of ``judge`` over ``pages``, for DuckDB: every rule's expression on every URL."""
    values = ", ".join(f"({_literal(r)}, {_literal(v)}, {rank}, {cased}, {_literal(x)})" for r, v, rank, cased, x, _ in rules)
    lower = f"translate(%s, '{UPPER}', '{LOWER}')"
    return rf"""
with split as (
    select page_id, coalesce(url, '') as url, strpos(coalesce(url, ''), '://') as mark,
        case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
    from pages
),
parts as (
    select page_id, {lower % "regexp_extract(rest, '^[^/?#]*')"} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
        case when mark > 0 then '://' || {lower % "regexp_extract(rest, '^[^/?#]*')"} || regexp_extract(rest, '(?s)^[^/?#]*(.*)', 1) else url end as t
    from split
),
urls as (select distinct t, {lower % "t"} as lowered from parts),
rules (rule, verdict, rank, cased, regex) as (values {values}),
hits as (
    select t, arg_min(struct_pack(rule := rule, verdict := verdict, rank := rank), row(-rank, -length(rule), rule, verdict)) as best
    from urls join rules on regexp_matches(case when cased then t else lowered end, regex) group by t
)
select page_id, host, path, case when best.rank = 2 then best.rule end as rule, coalesce(best.verdict, 'allow') as verdict,
    case when best.rank < 2 then best.rule end as pattern
from parts left join hits using (t)
"""
