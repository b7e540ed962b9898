"""Text expressions: words, stems, keys, tags, shingles, fingerprints, redaction. All stay in the JVM unless noted."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: letters, digits, marks and underscores, joined by dots or hyphens inside.
WORD = r"[\p{L}\p{N}\p{M}_]+(?:[.\-][\p{L}\p{N}\p{M}_]+)*"
#: English words that carry no meaning of their own, and words of a request.
STOP = (
    "a", "an", "the", "and", "or", "of", "for", "to", "in", "on", "with", "is", "are", "be", "can", "how", "what",
    "which", "when", "where", "why", "does", "do", "it", "its", "by", "from", "as", "at", "we", "our", "should",
    "about", "after", "all", "any", "also", "been", "but", "did", "has", "have", "into", "kb", "much",
    "long", "more", "not", "only", "same", "than", "that", "their", "then", "there", "these", "they",
    "this", "those", "was", "were", "will", "would", "you", "your", "who", "whom", "whose",
    "doing", "get", "set", "use", "used", "using", "via", "per", "say", "says",
    "answer", "answers", "cite", "citation", "citations", "please", "explain", "tell", "give",
    "describe", "briefly", "safely", "help", "need", "want", "know",
)
#: Kinds of evidence tags.
TAG_KINDS = ("DOC", "CODE", "DER", "COMMUNITY", "UNK", "DECISION", "LOG")


def words(c: Column) -> Column:
    """Lower-case words of a text, in order; an empty list for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def raw_words(c: Column) -> Column:
    """The words of a text as written, in order; an empty list for null."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_parts(w: Column) -> Column:
    """array<struct<part, weight, whole>>: a word and what it is made of, each part once.

    The word in lower case, without a v before a version; the pieces between its dots and hyphens; the dotted numbers
    between its hyphens: weight 1. The pieces of a name in CamelCase or with underscores: weight .2.
    """
    low = F.lower(w)
    t = F.when(low.rlike(r"^v\d+\.\d"), F.substring(low, 2, 1_000_000_000)).otherwise(low)
    none = F.array().cast("array<string>")
    pieces = F.when(t.rlike(r"[.\-]"), F.split(t, r"[.\-]")).otherwise(none)
    dotted = F.when(t.contains("-"), F.filter(F.split(t, "-"), lambda x: x.rlike(r"^\d+(\.\d+)+$"))).otherwise(none)
    camel = F.when(w.contains("_") | w.rlike("[a-z][A-Z]"), F.transform(F.split(F.regexp_replace(w, "([a-z0-9])([A-Z])", "$1_$2"), r"[_.\-]"), lambda x: F.lower(x))).otherwise(none)
    full = F.array_distinct(F.concat(F.array(t), pieces, dotted))
    more = F.array_except(F.array_distinct(camel), full)
    return F.concat(F.transform(full, lambda x: F.struct(x.alias("part"), F.lit(1.0).alias("weight"), (x == t).alias("whole"))), F.transform(more, lambda x: F.struct(x.alias("part"), F.lit(0.2).alias("weight"), F.lit(False).alias("whole"))))


def stem_steps(w: str) -> list[str]:
    """The steps of the English stem of a lower-case word named w, each an expression over the last one's result.

    Up to two suffixes of ies, ing, ed, es, s go (s not after ss, us, is) where more than three letters stay, then a
    final e of words over four letters, then one of a doubled final letter. The expressions are plain SQL.
    """
    rules = [("ies", "|| 'y'"), ("ing", ""), ("ed", ""), ("es", "")]
    parts = [f"when length({w}) > {len(s) + 3} and {w} like '%{s}' then substr({w}, 1, length({w}) - {len(s)}) {tail}" for s, tail in rules]
    parts.append(f"when length({w}) > 4 and {w} like '%s' and not ({w} like '%ss' or {w} like '%us' or {w} like '%is') then substr({w}, 1, length({w}) - 1)")
    cut = f"case {' '.join(parts)} else {w} end"
    no_e = f"case when length({w}) > 4 and {w} like '%e' then substr({w}, 1, length({w}) - 1) else {w} end"
    last, before = f"substr({w}, length({w}), 1)", f"substr({w}, length({w}) - 1, 1)"
    single = f"case when length({w}) > 3 and {last} = {before} and {last} between 'a' and 'z' and {last} not in ('a','e','i','o','u','l','s') then substr({w}, 1, length({w}) - 1) else {w} end"
    return [cut, cut, no_e, single]


def stem(c: str) -> Column:
    """The stem of the column named c. Stem the distinct words of a corpus and join back, not every token."""
    x = c
    for k, step in enumerate(stem_steps("w")):
        x = f"transform(array({x}), w{k} -> {re.sub(r'\bw\b', f'w{k}', step)})[0]"
    return F.expr(x)


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode composition and case folding; needed only where texts are not ASCII."""
    return s.map(lambda x: unicodedata.normalize("NFC", x).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normal_form(c: Column) -> Column:
    """Text for comparison: plain quotes, no emphasis, lower case, single blanks, no punctuation at the end."""
    x = F.translate(_nfkc(c), "“”„‘’", "\"\"\"''")
    x = F.regexp_replace(x, r"[*_`]+", "")
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")), r"[.,;:!?]+$", "")


def fact_key(c: Column) -> Column:
    """12 hex digits that stay when only white space changes."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(c, r"\s+", " ")), 256), 1, 12)


def numbers(c: Column) -> Column:
    """The distinct numbers of a text, without thousands separators."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)), lambda n: F.regexp_replace(n, ",", "")))


def shingles(c: Column, n: int = 3) -> Column:
    """The distinct runs of n words; a shorter text is one shingle, an empty one has none."""
    w = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.array_distinct(F.when(F.size(w) >= n, runs).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared members over all members; 1 for two empty sets."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def simhash(sh: Column) -> Column:
    """A 64-bit fingerprint of a set of shingles, as 16 hex digits: each bit is the majority of the members' hashes."""
    def half(start: int) -> Column:
        h = F.transform(sh, lambda x: F.conv(F.substring(F.sha1(x), start, 8), 16, 10).cast("bigint"))

        def bit(k: int) -> Column:
            votes = F.aggregate(h, F.lit(0), lambda a, x: a + F.when(F.shiftright(x, k).bitwiseAND(1) == 1, 1).otherwise(-1))
            return F.when(votes > 0, F.lit(1 << k)).otherwise(0).cast("bigint")

        total = bit(0)
        for k in range(1, 32):
            total = total + bit(k)
        return F.lpad(F.lower(F.hex(total)), 8, "0")

    return F.concat(half(1), half(9))


def entropy(c: Column) -> Column:
    """Bits per character, rounded to 6 places; null for null, 0 for an empty text."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars)
    part = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, x: a - (F.size(F.filter(chars, lambda y: y == x)) / n) * F.log2(F.size(F.filter(chars, lambda y: y == x)) / n))
    return F.when(c.isNotNull(), F.round(F.when(n > 0, part).otherwise(0.0) + 0.0, 6))


def size_class(n: Column) -> Column:
    return F.when(n.isNull() | (n <= 0), "empty").when(n < 1000, "lt1k").when(n < 10_000, "lt10k").when(n < 100_000, "lt100k").otherwise("ge100k")


def url_normal(c: Column) -> Column:
    """Scheme and host in lower case; no default port, fragment, empty query or closing slash."""
    x = F.regexp_replace(c, r"#.*$", "")
    x = F.regexp_replace(x, r"\?$", "")
    head = F.lower(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*", 0))
    rest = F.substring(x, F.length(head) + 1, F.length(x))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://[^/]*?):80$", "$1"), r"^(https://[^/]*?):443$", "$1")
    return F.concat(head, F.regexp_replace(rest, r"/(\?|$)", "$1"))


def source_id(url: Column, prefix: str = "S-") -> Column:
    """prefix and 8 base32 letters of the hash of a url: 40 bits, five at a time."""
    v = F.conv(F.substring(F.sha2(url, 256), 1, 10), 16, 10).cast("bigint")
    letters = "abcdefghijklmnopqrstuvwxyz234567"
    return F.concat(F.lit(prefix), *[F.substring(F.lit(letters), (F.shiftright(v, 35 - 5 * k).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for k in range(8)])


def slug(c: Column, n: int = 6) -> Column:
    """Up to n words that are no stop words, joined by hyphens."""
    return F.array_join(F.slice(F.filter(words(c), lambda w: ~w.isin(*STOP)), 1, n), "-")


def tags(c: Column) -> Column:
    """array<struct<kind, ids, note>> of a line's evidence tags.

    A tag is in brackets; its parts are split by semicolons and begin with a kind; ids follow, split by commas, and a
    note after a colon. ``[UNK: why]`` has a note alone.
    """
    kinds = "|".join(TAG_KINDS)
    inner = F.transform(F.regexp_extract_all(c, F.lit(rf"\[((?:{kinds})\b[^\]]*)\]"), F.lit(1)), lambda t: F.split(t, r";\s*"))
    parts = F.filter(F.flatten(inner), lambda p: p.rlike(rf"^(?:{kinds})\b"))

    def one(p: Column) -> Column:
        kind = F.regexp_extract(p, rf"^({kinds})", 1)
        rest = F.trim(F.substring(p, F.length(kind) + 1, F.length(p)))
        ids = F.regexp_extract_all(F.regexp_extract(rest, r"^([^:]*)", 1), F.lit(r"[A-Z]+-?[a-z0-9]+"), F.lit(0))
        note = F.trim(F.regexp_extract(rest, r":\s*(.*)$", 1))
        return F.struct(kind.alias("kind"), ids.alias("ids"), F.when(note != "", note).alias("note"))

    return F.transform(parts, one)


def validity(c: Column) -> Column:
    """array<struct<start, end, error>> of the windows '(valid A..B)' of a line; an open side is null."""
    raw = F.regexp_extract_all(c, F.lit(r"\(valid (\d{4}-\d\d-\d\d)?\.\.(\d{4}-\d\d-\d\d)?\)"), F.lit(0))

    def one(w: Column) -> Column:
        a = F.regexp_extract(w, r"\(valid (\d{4}-\d\d-\d\d)?\.\.", 1)
        b = F.regexp_extract(w, r"\.\.(\d{4}-\d\d-\d\d)?\)", 1)
        s, e = F.expr("cast(null as date)"), F.expr("cast(null as date)")
        s = F.when(a != "", F.try_to_date(a)) if hasattr(F, "try_to_date") else F.when(a != "", F.to_date(a))
        e = F.when(b != "", F.try_to_date(b)) if hasattr(F, "try_to_date") else F.when(b != "", F.to_date(b))
        bad = ((a != "") & s.isNull()) | ((b != "") & e.isNull())
        return F.struct(s.alias("start"), e.alias("end"), F.when(bad, "no date").when(s > e, "ends before it starts").alias("error"))

    return F.transform(raw, one)


def valid_on(windows: Column, day: Column) -> Column:
    """Whether a line with these windows holds on a day: it has none, or one that holds the day (both ends included)."""
    inside = F.exists(windows, lambda w: w["error"].isNull() & (w["start"].isNull() | (w["start"] <= day)) & (w["end"].isNull() | (w["end"] >= day)))
    return (F.size(windows) == 0) | inside


def clip(c: Column, n: int) -> Column:
    """At most n characters, cut between words, with an ellipsis where something is left out."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, n - 1), r"\s+\S*$", ""), F.lit("…")))


def sentences(c: Column) -> Column:
    """Parts after '. ', '; ' or ': ' before a capital; code spans stay whole."""
    masked = F.regexp_replace(c, r"(?<=[.;:]) (?=\p{Lu})(?=(?:[^`]*`[^`]*`)*[^`]*$)", "\u0001")
    return F.split(masked, "\u0001")


def cells(c: Column) -> Column:
    """The cells of a table row: parts between pipes that are not escaped."""
    inner = F.regexp_replace(F.trim(c), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: F.trim(F.regexp_replace(x, r"\\\|", "|")))


def version_key(c: Column) -> Column:
    """The numbers of a dotted version as an array, which orders versions."""
    return F.transform(F.split(F.regexp_extract(c, r"\d+(?:\.\d+)*", 0), r"\."), lambda x: x.try_cast("int"))


#: Rules of ``redact`` in their order: kind, pattern, replacement. Applying them again changes nothing.
REDACT = (
    ("key", r"-----BEGIN [A-Z ]+-----[\s\S]*?-----END [A-Z ]+-----", "<key>"),
    ("secret", r"\b(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_\-]{16,}\b", "<secret>"),
    ("assignment", r"(?i)\b(password|passwd|pwd|secret|api[_-]?key|token)(\s*[=:]\s*)(?!<)[^\s,;\"']{4,}", "$1$2<secret>"),
    ("auth", r"(?i)\b(authorization:\s*(?:bearer|basic)\s+)(?!<)\S+", "$1<secret>"),
    ("userinfo", r"(https?://)[^/\s:@<]+:[^/\s@<]+@", "$1<user>@"),
    ("unc", r"\\\\[A-Za-z0-9._\-]+\\[^\s\"']+", "<share>"),
    ("drive", r"\b[A-Za-z]:\\(?!<)[^\s\"']+", "<path>"),
    ("home", r"/(?:home|Users)/(?!<)[^/\s]+", "/home/<user>"),
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,250}\.[A-Za-z]{2,}", "<email>"),
    ("sid", r"\bS-1-5-[0-9\-]{6,}\b", "<sid>"),
    ("guid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<guid>"),
    ("ipv4", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "<ip>"),
)


def redact(c: Column) -> Column:
    """The text with what may identify a machine, a secret or a mailbox replaced, rule after rule."""
    for _, pattern, to in REDACT:
        c = F.regexp_replace(c, pattern, to)
    return c


def leaks(c: Column) -> Column:
    """array<struct<kind, value>> of what ``redact`` would replace."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.when(c.isNotNull(), F.concat(*[of(k, p) for k, p, _ in REDACT]))


def html_text(c: Column) -> Column:
    """The readable text of a page: no scripts, tags or references."""
    x = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    x = F.regexp_replace(x, r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for ref, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(ref), F.lit(to))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def error_line(c: Column) -> Column:
    """A failure line without what differs from run to run: times, ids, numbers, paths."""
    x = F.regexp_replace(c, r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d\S*", "<time>")
    x = F.regexp_replace(x, r"0x[0-9a-fA-F]+|\b[0-9a-f]{8,}\b", "<id>")
    x = F.regexp_replace(x, r"(?:/[\w.\-]+){2,}", "<path>")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\d+", "<n>"), r"\s+", " "))


def command_class(c: Column) -> Column:
    """The program a shell command runs, past assignments, wrappers and directories."""
    x = F.regexp_replace(F.trim(c), r"^(?:(?:sudo|env|time|nohup|timeout \S+)\s+|[A-Za-z_]\w*=\S*\s+)+", "")
    return F.when(x == "", None).otherwise(F.regexp_extract(F.regexp_extract(x, r"^(\S+)", 1), r"([^/\\]+)$", 1))


def split_list(c: Column) -> Column:
    """The parts of a list written with commas or semicolons, in brackets or not; blanks are left out."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"^\s*\[|\]\s*$", ""), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def iso_week(ts: Column) -> Column:
    """The ISO year and week as 'yyyy-Www'."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
