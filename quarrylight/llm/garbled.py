"""Text decoded with the wrong character encoding: found and restored by noisy-channel decoding.

The source is clean text with the word frequencies of the corpus; a channel (true encoding, wrong decoder) turns its
bytes into what is seen. Decoding works on the distinct tokens of the corpus that hold a non-ASCII character:

1. Tokens are counted over all texts. Words and signs of tokens that no channel explains make up the language model.
2. A token's byte lattice has an arc for each character kept as it is, and for each run of characters whose bytes
   under a channel's wrong decoder are one UTF-8 character; a lost byte (U+FFFD) is a wildcard for the bytes the
   decoder has no character for. Viterbi search keeps each channel's PATHS best readings under the signs' frequencies,
   so that words can choose between them where a run may be read or kept, or what a lost byte was is open.
   Channels between one-byte encodings map every character they can; UTF-8 channels are tried twice, for text that
   was garbled twice.
3. The readings' words are looked up by a join with the language model. A reading wins if its words are by so much
   more frequent than those of the token as it stands.
4. Texts with a winning token, or with U+FFFD, are the affected ones. Readings of one-byte channels with no word of
   STRONG letters are too short to tell by themselves and only count in texts with another one. Restoring replaces the tokens; a token with lost
   characters becomes the most frequent token of the corpus that fits it with wildcards.

Defined results: null, empty and ASCII texts are never affected; what is lost for good keeps its U+FFFD; character
references, drawn lines and rare letters that no channel explains are left as they are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.session import BROADCAST_ROWS, materialise

LOST = "�"
#: Wrong decoders of UTF-8 bytes.
WIDE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp852", "mac_roman", "iso8859_2", "cp866", "koi8_r", "cp1254", "cp1257", "cp1253")
#: (wrong decoder, true encoding) between one-byte encodings.
NARROW = (("cp1252", "cp1250"), ("cp1252", "iso8859_2"), ("cp1250", "cp1252"), ("cp1252", "cp1251"), ("cp1251", "cp1252"), ("cp1252", "koi8_r"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp852", "cp1250"), ("cp1250", "cp852"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"), ("cp1251", "mac_cyrillic"), ("cp1252", "cp1254"), ("cp1252", "cp1253"))
#: Decoders whose own characters are letters of one other script; under them a garbled word is garbled throughout.
CYRILLIC = frozenset({"cp1251", "cp866", "koi8_r"})
#: What a reading must gain over the token as it stands (natural logarithm of the odds).
WIDE_GAIN, NARROW_GAIN = 1.5, 2.3
#: Letters of the longest word that a reading of a one-byte channel needs to count by itself.
STRONG = 3
#: Readings that are kept of a channel that explains a token, and characters that are kept for a run with lost bytes.
PATHS, FILLS = 6, 4
#: Weight of a word the corpus does not have.
UNSEEN = 0.05

WORD = re.compile(r"[^\W\d_]+")
_PUNCT = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


@lru_cache(64)
def bytes_of(decoder: str) -> dict[str, int]:
    """The byte of every character a wrong decoder gives; bytes it has no character for come through as controls."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(decoder)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


@lru_cache(64)
def gaps_of(decoder: str) -> tuple[int, ...]:
    """The bytes a decoder has no character for, which are those that get lost."""
    out = []
    for b in range(128, 256):
        try:
            bytes([b]).decode(decoder)
        except UnicodeDecodeError:
            out.append(b)
    return tuple(out)


@lru_cache(100_000)
def usual(ch: str) -> bool:
    """Whether a character is of a common script or kind of sign, so that a reading may hold it unseen."""
    c, cat = ord(ch), unicodedata.category(ch)
    if cat in ("Cn", "Co", "Cs", "Cc"):
        return False
    if c < 0x180:
        return c >= 0xA0
    if c in (0x192, 0x2C6, 0x2DC) or 0x218 <= c <= 0x21B:
        return True
    if cat[0] == "M":
        return c in (0x300, 0x301, 0x302, 0x303, 0x308, 0x30C, 0x327, 0xFE0F)
    return 0x386 <= c <= 0x3CE or 0x400 <= c <= 0x45F or c in (0x490, 0x491) or 0x5D0 <= c <= 0x5EA or 0x620 <= c <= 0x64A or c >= 0x2000 or (0xE00 <= c <= 0xE5B)


class Signs:
    """Frequencies of non-ASCII characters."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.total = sum(counts.values()) + 1
        # the known characters by the bytes they begin with, for runs with lost bytes
        self.led: dict[int, list[tuple[int, bytes, str]]] = {}
        for ch, n in counts.items():
            if ch > "\x7f" and n > 1 and not "\ud800" <= ch <= "\udfff":
                raw = ch.encode()
                self.led.setdefault(raw[0], []).append((-n, raw, ch))
        for x in self.led.values():
            x.sort()
        self.fits: dict[tuple, list[tuple[str, float]]] = {}

    def log(self, ch: str) -> float:
        n = self.counts.get(ch, 0)
        return math.log((n if n else 0.5 if usual(ch) else 0.001) / self.total)

    def plausible(self, ch: str) -> bool:
        return usual(ch) or self.counts.get(ch, 0) > 1

    def fitting(self, lead: int, options: tuple[tuple[int, ...], ...]) -> list[tuple[str, float]]:
        """(character, cost) of the FILLS cheapest plausible characters with this lead byte and one of the options each.

        Known characters are looked through; of the others, which all cost the same, the first in byte order is taken.
        """
        found = self.fits.get((lead, options))
        if found is None:
            sets = [frozenset(o) for o in options]
            known = [ch for _, raw, ch in self.led.get(lead, ()) if len(raw) == len(sets) + 1 and all(b in o for b, o in zip(raw[1:], sets)) and self.plausible(ch)]
            found = [(ch, -self.log(ch)) for ch in known[:FILLS]]
            if len(found) < FILLS and lead not in (0xF1, 0xF2):  # no character of these planes is assigned
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                for rest in product([b for b in options[0] if low <= b <= high], *options[1:]):
                    ch = bytes((lead, *rest)).decode()
                    if usual(ch) and not self.counts.get(ch):
                        found.append((ch, -self.log(ch)))
                        break
            self.fits[lead, options] = found = sorted(found, key=lambda x: (x[1], x[0]))
        return found


def _spans(token: str, i: int, table: dict[str, int], gaps: tuple[int, ...], signs: Signs) -> Iterator[tuple[int, str, float]]:
    """The UTF-8 characters that may be read from position i: (characters used, character, cost)."""
    lead = table.get(token[i])
    if lead is None or not 0xC2 <= lead <= 0xF4:
        return
    need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    part = token[i : i + need]
    if len(part) < need:
        return
    options: list[tuple[int, ...]] = []
    for ch in part[1:]:
        if ch == LOST:
            options.append(tuple(b for b in gaps if 0x80 <= b < 0xC0) or tuple(range(0x80, 0xC0)))
        else:
            b = table.get(ch)
            if b is None or not 0x80 <= b < 0xC0:
                return
            options.append((b,))
    if LOST in part:
        for ch, cost in signs.fitting(lead, tuple(options)):
            yield need, ch, cost
        return
    try:
        ch = bytes([lead, *(o[0] for o in options)]).decode()
    except UnicodeDecodeError:
        return
    if signs.plausible(ch):
        yield need, ch, -signs.log(ch)


def wide_readings(token: str, decoder: str, signs: Signs, paths: int = PATHS) -> list[str]:
    """The cheapest paths through the token's lattice, if the cheapest uses the channel; else none.

    Linear in the token's length, times paths. Each place keeps its cheapest ways to it: (cost, place before, way there).
    """
    table, gaps = bytes_of(decoder), gaps_of(decoder)
    n = len(token)
    ways: list[list[tuple[float, int, int, str]]] = [[] for _ in range(n + 1)]
    ways[0] = [(0.0, -1, 0, "")]
    own = decoder in CYRILLIC
    for i in range(n):
        here = ways[i] = sorted(ways[i])[:paths] if len(ways[i]) > 1 else ways[i]
        ch = token[i]
        keep = 0.0 if ch < "\x80" else 25.0 if "\x80" <= ch < "\xa0" else -signs.log(ch)
        ways[i + 1] += [(w[0] + keep, i, k, ch) for k, w in enumerate(here)]
        if ch >= "\x80":
            for used, read, c in _spans(token, i, table, gaps, signs):
                ways[i + used] += [(w[0] + c, i, k, read) for k, w in enumerate(here)]
    ways[n] = sorted(ways[n])[:paths]
    out: list[str] = []
    for at in range(len(ways[n])):
        i, k, parts, used, bad = n, at, [], False, False
        while i:
            _, j, kk, read = ways[i][k]
            used |= i - j > 1
            bad |= own and i - j == 1 and read >= "\x80" and read.isalpha()
            parts.append(read)
            i, k = j, kk
        if used and not bad:
            out.append("".join(reversed(parts)))
        elif not at:
            return []
    return out


def wide_reading(token: str, decoder: str, signs: Signs) -> str | None:
    """The cheapest path through the token's lattice if it uses the channel, else None."""
    return next(iter(wide_readings(token, decoder, signs, 1)), None)


@lru_cache(64)
def _narrow_map(decoder: str, true: str) -> dict[int, str]:
    out = {}
    for ch, b in bytes_of(decoder).items():
        try:
            read = bytes([b]).decode(true)
        except UnicodeDecodeError:
            continue
        if read != ch and not "\x80" <= read < "\xa0":
            out[ord(ch)] = read
    return out


def readings(token: str, signs: Signs) -> list[tuple[str, str]]:
    """(channel, reading) of every channel that explains the token, each reading once."""
    out: dict[str, str] = {}
    for d in WIDE:
        found = wide_readings(token, d, signs)
        for r in found:
            out.setdefault(r, f"utf-8<{d}")
        for r in found[:1]:
            for again in (d, "cp1252", "latin-1"):
                rr = wide_reading(r, again, signs)
                if rr is not None:
                    out.setdefault(rr, f"utf-8<{d} twice")
    if LOST not in token:
        for d, true in NARROW:
            r = token.translate(_narrow_map(d, true))
            if r != token:
                out.setdefault(r, f"{true}<{d}")
    return [(c, r) for r, c in out.items()]


def explained(token: str, signs: Signs) -> bool:
    """Whether the token is left out of the language model: a UTF-8 channel explains it, or something is lost."""
    return LOST in token or any("\x80" <= c < "\xa0" for c in token) or any(wide_reading(token, d, signs) is not None for d in WIDE)


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """token, n: the tokens (between ASCII white space) that hold a non-ASCII character, counted over all texts.

    Each task counts its own first; it hands on what it has whenever it holds too many distinct tokens.
    """
    schema = pa.schema([("token", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                if t and not t.isascii():
                    seen.update([x for x in t.split() if not x.isascii()])
            if len(seen) > 200_000:
                yield from flush(seen)
        yield from flush(seen)

    def flush(seen: Counter) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([t.decode("utf-8", "replace") for t in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], schema=schema)
        seen.clear()

    return docs.select(text).mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _signs_of(tokens: DataFrame) -> dict[str, int]:
    """Counts of non-ASCII characters; there are no more of them than Unicode has characters."""
    c = tokens.select(F.explode(F.split(F.regexp_replace("token", r"[\x00-\x7F]", ""), "")).alias("c"), "n").where("c != ''")
    return {r["c"]: r["n"] for r in c.groupBy("c").agg(F.sum("n").alias("n")).collect()}


def decoded(tokens: DataFrame) -> DataFrame:
    """token, channel, reading, gain of every distinct token that a channel explains better; tokens from token_counts."""
    spark = tokens.sparkSession
    raw = spark.sparkContext.broadcast(_signs_of(tokens))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = Signs(raw.value)
        for b in batches:
            t = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([explained(x, signs) for x in t], pa.bool_())], names=["token", "n", "odd"])

    marked = materialise(tokens.mapInArrow(split, "token string, n bigint, odd boolean"), "tokens")
    clean = marked.where("not odd")
    signs_clean = spark.sparkContext.broadcast(_signs_of(clean))
    word = F.explode(F.regexp_extract_all("token", F.lit(r"[\p{L}\p{M}]*[^\x00-\x7F\P{L}][\p{L}\p{M}]*"), F.lit(0))).alias("word")
    words = clean.select(word, "n").groupBy("word").agg(F.sum("n").alias("f"))
    words = materialise(words, "words")
    total = float(words.agg(F.sum("f")).first()[0] or 0) + 1.0

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = Signs(signs_clean.value)
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                found = readings(t, signs)
                for k, (channel, r) in enumerate([("", t), *found] if found else []):
                    ws = [w for w in WORD_NON_ASCII.findall(r)]
                    base = sum(signs.log(c) for c in WORD_NON_ASCII.sub("", r) if c >= "\x80") - 8.0 * sum("\x80" <= c < "\xa0" or c == LOST for c in r)
                    # a word the corpus does not have is as likely as its signs
                    back = [UNSEEN / total * math.exp(max(-600.0, sum(signs.log(c) for c in w if c >= "\x80"))) for w in ws]
                    out.append((t, k, channel, r, base, list(zip(ws, back))))
            a = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.string()), pa.array(a[1], pa.int32()), pa.array(a[2], pa.string()), pa.array(a[3], pa.string()), pa.array(a[4], pa.float64()), pa.array([[{"word": w, "back": p} for w, p in x] for x in a[5]], pa.list_(pa.struct([("word", pa.string()), ("back", pa.float64())])))], names=["token", "k", "channel", "reading", "base", "ws"])

    cand = marked.select("token").mapInArrow(propose, "token string, k int, channel string, reading string, base double, ws array<struct<word:string,back:double>>")
    long = cand.select("token", "k", "channel", "reading", "base", F.explode_outer("ws").alias("w")).select("token", "k", "channel", "reading", "base", "w.word", "w.back")
    p = F.log(F.coalesce("f", F.lit(0)) / total + F.col("back") + F.lit(1e-300))
    scored = long.join(words, "word", "left").groupBy("token", "k", "channel", "reading", "base").agg(F.coalesce(F.sum(p), F.lit(0.0)).alias("lp"), F.coalesce(F.min(F.when(F.col("word").isNotNull(), F.coalesce("f", F.lit(0)))), F.lit(0)).alias("known"))
    s = scored.withColumn("score", F.col("base") + F.col("lp"))
    own = s.where("k = 0").select("token", F.col("score").alias("own"))
    gain = s.where("k > 0").join(own, "token").withColumn("gain", F.col("score") - F.col("own"))
    wide = F.col("channel").startswith("utf-8")
    good = gain.where((wide & (F.col("gain") > WIDE_GAIN)) | (~wide & (F.col("gain") > NARROW_GAIN) & (F.col("known") > 1)))
    return good.groupBy("token").agg(F.max_by(F.struct("channel", "reading", "gain"), F.struct("gain", F.length("reading"), "reading")).alias("b")).select("token", "b.*")


WORD_NON_ASCII = re.compile(r"[^\W\d_]*[^\W\d_\x00-\x7f][^\W\d_]*")


def _bare(c: str) -> F.Column:
    return F.regexp_replace(c, r"^[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+$", "")


def filled(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """token, reading of tokens with lost characters: the corpus's most frequent token that fits, with wildcards.

    A lost character is one U+FFFD, or as many as its UTF-8 form has bytes.
    """
    lost = tokens.where(F.col("token").contains(LOST)).select("token", _bare("token").alias("mask"))
    clean = tokens.where(~F.col("token").contains(LOST)).join(table, "token", "left_anti").select(_bare("token").alias("word"), "n")
    by = lambda c: F.regexp_replace("word", r"[^\x00-\x7F]", c)
    masks = clean.select("word", "n", F.explode(F.array_distinct(F.array(by(LOST), by(LOST * 2), by(LOST * 3)))).alias("mask"))
    best = masks.groupBy("mask", "word").agg(F.sum("n").alias("n")).groupBy("mask").agg(F.max_by("word", F.struct("n", "word")).alias("word"))
    # a mask of lost characters alone says nothing
    fit = lost.where(F.length(F.regexp_replace("mask", LOST, "")) >= 2).join(best, "mask")
    return fit.select("token", F.expr("replace(token, mask, word)").alias("reading"))


def flagged(docs: DataFrame, text: str = "text") -> DataFrame:
    """token, reading, strong: the damaged tokens of the corpus; reading is null where nothing better is known.

    strong is false where the token doesn't count by itself.
    """
    tokens = materialise(token_counts(docs, text), "counts")
    table = materialise(decoded(tokens), "decoded")
    lost = tokens.where(F.col("token").contains(LOST)).join(table, "token", "left_anti").select("token").join(filled(tokens, table), "token", "left")
    longest = F.array_max(F.transform(F.regexp_extract_all("reading", F.lit(r"[\p{L}\p{M}]+"), F.lit(0)), lambda w: F.length(w)))
    strong = F.col("channel").startswith("utf-8") | (F.coalesce(longest, F.lit(0)) >= STRONG)
    return materialise(table.select("token", "reading", strong.alias("strong")).unionByName(lost.withColumn("strong", F.lit(True))), "flagged")


_PIECES = re.compile(rb"([ \t\n\r\x0b\x0c]+)")


def affected(docs: DataFrame, restore: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key of every affected text; with restore=True also restored, its text with the damaged tokens replaced."""
    table = flagged(docs, text)
    kind = dict(docs.dtypes)[key]
    if table.count() > BROADCAST_ROWS:
        return _affected_by_join(docs, table, restore, key, text)
    rows = table.collect()
    known_all = {r["token"].encode(): r["reading"].encode() if r["reading"] is not None else None for r in rows}
    shared = docs.sparkSession.sparkContext.broadcast((known_all, {r["token"].encode() for r in rows if r["strong"]}))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = shared.value
        for b in batches:
            ids, fixed = [], []
            for i, t in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                if t and not t.isascii() and not names.isdisjoint(t.split()):
                    ids.append(i)
                    if restore:
                        fixed.append(b"".join(known.get(x) or x for x in _PIECES.split(t)).decode("utf-8", "replace"))
            cols = [b.column(0).take(pa.array(ids, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(fixed, pa.string())] * restore, names=[key, "restored"][: 1 + restore])

    return docs.select(key, text).mapInArrow(scan, f"`{key}` {kind}" + ", restored string" * restore)


def _affected_by_join(docs: DataFrame, table: DataFrame, restore: bool, key: str, text: str) -> DataFrame:
    """The same for a table of damaged tokens too large to broadcast: texts' tokens are joined with it."""
    kind = dict(docs.dtypes)[key]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, t in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                if t and not t.isascii():
                    own = {x for x in t.split() if not x.isascii()}
                    ids += [i] * len(own)
                    out += [x.decode("utf-8", "replace") for x in own]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(out, pa.string())], names=[key, "token"])

    pairs = docs.select(key, text).mapInArrow(explode, f"`{key}` {kind}, token string").join(table, "token")
    if not restore:
        return pairs.where("strong").select(key).distinct()
    fixes = pairs.groupBy(key).agg(F.max("strong").alias("strong"), F.map_from_entries(F.collect_set(F.struct("token", F.coalesce("reading", "token").alias("reading")))).alias("fix")).where("strong")
    parts = F.split(F.col(text), r"(?<=[ \t\n\r\x0b\x0c])|(?=[ \t\n\r\x0b\x0c])")
    return docs.join(fixes, key).select(key, F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at("fix", p), p)), "").alias("restored"))
