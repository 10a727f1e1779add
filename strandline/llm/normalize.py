"""One consistent form for text that looks the same but differs in its characters.

A text with any character that could need it is exploded to positioned code
points; broadcast tables give each its decomposition, combining class and
script; invisible characters go, unusual spaces become plain ones, look-alike
letters of another script are put back into the script of their word,
combining marks are ordered by class and recomposed with their base, and the
string is rebuilt. All steps after the first grouping by text run in the same
partitions, without a further shuffle. Texts of plain characters only are in
the consistent form already and pass untouched.

The tables are built by rule from the Unicode database of the Python runtime;
only the look-alike letters and the ranges of invisible characters are listed.
"""

from __future__ import annotations

import sys
import unicodedata as ud
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.skew import lookup_join

#: Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
    # Cyrillic
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "ү": "y", "Ӏ": "I", "ѵ": "v",
}
#: Ranges of characters that are not seen (first, last).
INVISIBLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
#: Joiners and selectors that shape Arabic and Indic letters and emoji, and the ranges of those.
SHAPING = (0x200C, 0x200D, 0xFE0E, 0xFE0F)
SHAPED = ((0x600, 0xDFF), (0x1000, 0x109F), (0x1780, 0x18AF), (0x2190, 0x2BFF), (0x1F000, 0x1FAFF))
#: Hyphens that look like the plain one.
HYPHENS = (0x2010, 0x2011)
#: Kinds of compatibility decomposition whose source looks like its plain spelling.
LIKE_PLAIN = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Blocks that most texts are made of.
PLAIN_BLOCKS = ((0x00, 0x17F), (0x3001, 0x3029), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
DOTS = (0x2024, 0x2025, 0x2026)

_HAN = r"\p{IsHan}"


def _script(ch: str) -> str:
    name = ud.name(ch, "")
    for script in ("LATIN", "GREEK", "CYRILLIC"):
        if name.startswith(script):
            return script
    return "OTHER"


def _is(cp: int, ranges: Sequence[tuple[int, int]]) -> bool:
    return any(a <= cp <= b for a, b in ranges)


def decompose(ch: str) -> tuple[str, bool] | None:
    """What ``ch`` is taken apart to, and whether only outside Chinese text; None where it stands."""
    cp = ord(ch)
    if _is(cp, INVISIBLE):
        return "", False
    if cp in HYPHENS:
        return "-", False
    if ud.category(ch) == "Zs":
        return (" ", False) if ch != " " else None
    if cp in DOTS or 0xAC00 <= cp <= 0xD7A3:
        return None
    raw = ud.decomposition(ch)
    if not raw:
        return None
    kind = raw.split(" ", 1)[0]
    if kind.startswith("<") and kind not in LIKE_PLAIN:
        return None
    full = ud.normalize("NFKD" if kind.startswith("<") else "NFD", ch)
    if full.startswith(" ") or full == ch:
        return None
    punctuation = kind == "<wide>" and ud.category(full[0])[0] in "PS"
    return full, punctuation


@lru_cache(maxsize=1)
def tables() -> tuple[list, list, str]:
    """(ch, taken apart, outside Chinese only), (base, marks -> composed), and a character class of all that may need work."""
    parts, comps, touched = [], {}, []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0x20000 <= cp <= 0x2F7FF or 0x30000 <= cp <= 0xDFFFF or cp > 0xE0FFF:
            continue
        ch = chr(cp)
        apart = decompose(ch)
        if apart is not None:
            parts.append((ch, *apart))
            canonical = ud.normalize("NFD", ch)
            if len(canonical) > 1 and ud.normalize("NFC", ch) == ch:
                comps.setdefault(canonical[0], {})[canonical[1:]] = ch
        if _touched(ch):  # a precomposed letter alone needs nothing
            touched.append(cp)
    ranges: list[list[int]] = []
    for cp in touched:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    pattern = "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in ranges) + "]"
    return parts, sorted(comps.items()), pattern


@lru_cache(maxsize=1)
def _letters() -> list[tuple[str, str, str | None]]:
    """(letter, script, look-alike in Latin) of the letters that can be mistaken, and the Latin twin's way back."""
    latin = sorted(set(LOOKALIKES.values()))
    return [(c, _script(c), t) for c, t in LOOKALIKES.items()] + [(c, "LATIN", c) for c in latin]


def _back(spark: SparkSession) -> DataFrame:
    """Latin letters with their twins in Greek and Cyrillic."""
    twin: dict[str, dict[str, str]] = {}
    for c, t in LOOKALIKES.items():
        twin.setdefault(t, {}).setdefault(_script(c), c)
    return spark.createDataFrame([(t, v.get("GREEK"), v.get("CYRILLIC")) for t, v in sorted(twin.items())], "ch string, greek string, cyrillic string")


@lru_cache(maxsize=1)
def _plain() -> tuple[str, str]:
    """Patterns of texts that surely need no work: of plain blocks only, and the same with full-width punctuation."""
    touched = {cp for block in PLAIN_BLOCKS for cp in range(block[0], block[1] + 1) if _touched(chr(cp))}
    ranges: list[list[int]] = []
    for a, b in PLAIN_BLOCKS:
        for cp in range(a, b + 1):
            if cp in touched:
                continue
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    body = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    wide = "".join(f"\\x{{{cp:X}}}" for cp in range(0xFF01, 0xFF66) if (d := decompose(chr(cp))) and d[1])
    return f"^[{body}]*+$", f"^[{body}{wide}]*+$"


def _touched(ch: str) -> bool:
    if ch in LOOKALIKES or ud.combining(ch):
        return True
    return decompose(ch) is not None and not (len(ud.normalize("NFD", ch)) > 1 and ud.normalize("NFC", ch) == ch)


def needs_work(c):
    """True where a text has a character that may not be in the consistent form.

    The long character class is only tried on texts that short ones don't clear.
    """
    plain, plain_chinese = _plain()
    return ~(c.rlike(plain) | (c.rlike(_HAN) & c.rlike(plain_chinese))) & c.rlike(tables()[2])


def normalized(texts: DataFrame, text: str) -> DataFrame:
    """(_t1, _t2, _norm) for each distinct text that may need work; _t1, _t2 are two hashes of the text."""
    spark = texts.sparkSession
    parts, comps, _ = tables()
    apart = F.broadcast(spark.createDataFrame(parts, "ch string, apart string, foreign_only boolean"))  # bounded by Unicode
    composed = F.broadcast(spark.createDataFrame(comps, "base string, comps map<string,string>"))
    alike = F.broadcast(spark.createDataFrame(_letters(), "ch string, script string, latin string"))
    twins = F.broadcast(_back(spark))
    classes = F.broadcast(spark.createDataFrame([(chr(cp), ud.combining(chr(cp))) for cp in range(0x300, 0x1F000) if ud.combining(chr(cp))], "ch string, ccc int"))

    single = texts.select(F.col(text).alias("_text")).where(needs_work(F.col("_text")))
    single = single.select(F.xxhash64("_text").alias("_t1"), F.xxhash64("_text", F.lit(7)).alias("_t2"), "_text").groupBy("_t1", "_t2").agg(F.first("_text").alias("_text"))
    ids = ["_t1", "_t2"]
    chinese = F.col("_text").rlike(_HAN)
    points = single.select(*ids, chinese.alias("chinese"), F.posexplode(F.regexp_extract_all("_text", F.lit("(?s)."), F.lit(0))).alias("pos", "ch"))
    whole = Window.partitionBy(*ids)
    line = whole.orderBy("pos", "sub")
    # Joiners that shape the character before them stay.
    points = points.withColumn("before", F.lag("ch").over(whole.orderBy("pos")))
    shaping = F.col("ch").isin(*[chr(c) for c in SHAPING]) & F.col("before").rlike("[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SHAPED) + "]")
    points = points.join(apart, "ch", "left")
    taken = F.when(F.col("apart").isNull() | shaping | (F.col("foreign_only") & F.col("chinese")), F.array("ch")).otherwise(F.regexp_extract_all("apart", F.lit("(?s)."), F.lit(0)))
    points = points.select(*ids, "pos", F.posexplode(taken).alias("sub", "ch"))
    points = points.join(classes, "ch", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0))).join(alike, "ch", "left").join(twins, "ch", "left")
    letter = F.col("ch").rlike(r"\p{L}")
    points = points.withColumn("letter", letter | (F.col("ccc") > 0))
    points = points.select("*", F.sum(F.when(F.col("letter"), 0).otherwise(1)).over(line).alias("word"), F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(line).alias("starter"))
    script = F.when(F.col("script").isNotNull(), F.col("script")).when(F.col("ch").rlike(r"\p{IsLatin}"), "LATIN").when(F.col("ch").rlike(r"\p{IsGreek}"), "GREEK").when(F.col("ch").rlike(r"\p{IsCyrillic}"), "CYRILLIC")
    points = points.withColumn("script", F.when(letter, script))
    # Letters without a twin in another script tell the script of their word and of the text. One number holds the
    # counts of a script: all its letters, and those without a twin times 2^32.
    scripts = ("LATIN", "GREEK", "CYRILLIC")
    count = {s: F.when(F.col("script") == s, F.when(F.col("latin").isNull(), 1 + (1 << 32)).otherwise(1)).otherwise(0).cast("long") for s in scripts}
    of = Window.partitionBy(*ids, "word")
    points = points.select("*", *[F.sum(count[s]).over(of).alias(f"w{s}") for s in scripts])
    points = points.select("*", *[F.sum(count[s]).over(whole).alias(f"t{s}") for s in scripts])
    low, high = (lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda c: F.shiftright(c, 32))
    kept = [c for c in points.columns if c[1:] not in scripts]
    points = points.select(*kept, *[f(F.col(f"{at}{s}")).alias(f"{at}_{name}{s.lower()}") for s in scripts for at in "wt" for name, f in (("", low), ("sure_", high))])
    mixed = F.greatest("w_latin", "w_greek", "w_cyrillic") < F.col("w_latin") + F.col("w_greek") + F.col("w_cyrillic")
    home = (
        F.when(mixed & (F.col("w_sure_latin") >= F.greatest("w_sure_greek", "w_sure_cyrillic")) & (F.col("w_sure_latin") > 0), "LATIN")
        .when(mixed & (F.col("w_sure_cyrillic") > 0) & (F.col("w_sure_cyrillic") >= F.col("w_sure_greek")), "CYRILLIC")
        .when(mixed & (F.col("w_sure_greek") > 0), "GREEK")
        .when(mixed, F.when(F.col("w_latin") > 0, "LATIN").otherwise("CYRILLIC"))
        .when((F.col("w_latin") == 0) & (F.col("t_latin") > 0) & (F.col("w_sure_greek") + F.col("w_sure_cyrillic") == 0) & (F.col("t_sure_greek") + F.col("t_sure_cyrillic") == 0), "LATIN")
    )
    points = points.withColumn("home", home)
    put = (
        F.when((F.col("home") == "LATIN") & (F.col("script") != "LATIN") & F.col("latin").isNotNull(), F.col("latin"))
        .when((F.col("home") == "GREEK") & (F.col("script") == "LATIN"), F.coalesce("greek", "ch"))
        .when((F.col("home") == "CYRILLIC") & (F.col("script") == "LATIN"), F.coalesce("cyrillic", "ch"))
        .otherwise(F.col("ch"))
    )
    points = points.withColumn("ch", put)
    # Order marks by class and recompose with the base.
    groups = points.groupBy(*ids, "starter").agg(
        F.max(F.when(F.col("ccc") == 0, F.col("ch"))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("ccc") > 0, F.struct("ccc", "pos", "sub", "ch")))).alias("marks"),
    )
    groups = groups.withColumn("look", F.when(F.size("marks") > 0, F.col("base")))
    groups = groups.join(composed, F.col("look") == composed["base"], "left").drop(composed["base"])
    empty = F.struct(F.lit("").alias("used"), F.lit("").alias("rest"), F.lit(0).alias("last"))
    step = lambda acc, m: F.when(
        (acc["last"] < m["ccc"]) & F.col("comps").isNotNull() & F.map_contains_key(F.col("comps"), F.concat(acc["used"], m["ch"])),
        F.struct(F.concat(acc["used"], m["ch"]).alias("used"), acc["rest"].alias("rest"), acc["last"].alias("last")),
    ).otherwise(F.struct(acc["used"].alias("used"), F.concat(acc["rest"], m["ch"]).alias("rest"), m["ccc"].alias("last")))
    groups = groups.withColumn("folded", F.when(F.size("marks") > 0, F.aggregate("marks", empty, step)))
    piece = F.when(F.col("folded").isNull(), F.coalesce("base", F.lit(""))).otherwise(
        F.concat(F.when(F.col("folded.used") != "", F.element_at("comps", F.col("folded.used"))).otherwise(F.coalesce("base", F.lit(""))), F.col("folded.rest"))
    )
    pieces = groups.select(*ids, "starter", piece.alias("piece"))
    rebuilt = pieces.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("starter", "piece"))).alias("p"))
    rebuilt = rebuilt.select(*ids, F.concat_ws("", F.transform("p", lambda x: x["piece"])).alias("_norm"))
    # A text of invisible characters only leaves no code point at all.
    return single.select(*ids).join(rebuilt, ids, "left").select(*ids, F.coalesce("_norm", F.lit("")).alias("_norm"))


def normalize_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the text ``columns`` in the consistent form.

    Null stays null, empty stays empty. All rows and all other columns are
    kept as they are. The form: no invisible characters (but joiners that
    shape Arabic, Indic or emoji), plain spaces and hyphens, full-width letters
    and digits narrowed, full-width punctuation narrowed except in a text with
    Chinese characters, ligatures and compatibility characters spelled out,
    accents composed with their letter, letters from the script of their word.
    A word wholly in another script stays, unless all its letters are
    look-alikes and nothing else in the text is surely of that script.
    Conjoining Hangul jamo are left as they are.
    """
    texts = None
    for c in columns:
        part = df.select(F.col(c).alias("_any"))
        texts = part if texts is None else texts.unionByName(part)
    norm = normalized(texts, "_any")
    out = df
    for i, c in enumerate(columns):
        h = (F.when(needs_work(F.col(c)), F.xxhash64(c)), F.when(needs_work(F.col(c)), F.xxhash64(F.col(c), F.lit(7))))
        mine = norm.select(F.col("_t1").alias(f"_h{i}"), F.col("_t2").alias(f"_g{i}"), F.col("_norm").alias(f"_n{i}"))
        rough = out.withColumn(f"_h{i}", h[0]).withColumn(f"_g{i}", h[1])
        # Texts without need of work have no hash and stay out of the join; texts that very many rows hold don't meet in one task.
        idle = rough.where(F.col(f"_h{i}").isNull()).withColumn(f"_n{i}", F.lit(None).cast("string"))
        busy = lookup_join(rough.where(F.col(f"_h{i}").isNotNull()), mine, [f"_h{i}", f"_g{i}"]).select(*idle.columns)
        out = idle.unionByName(busy).withColumn(c, F.coalesce(f"_n{i}", c)).drop(f"_h{i}", f"_g{i}", f"_n{i}")
    return out


def unusual_fields(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(``key``, field) for each field whose text is not in the consistent form. ``fields``: name -> column.

    Null and empty texts, and rows with a null key, are no cases. Distinct.
    """
    long = df.select(F.col(key).alias(key), F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("_text")) for n, c in fields.items()])))
    long = long.where(F.col(key).isNotNull() & needs_work(F.col("_text"))).withColumn("_was", F.col("_text"))
    return normalize_columns(long, ["_text"]).where(~F.col("_text").eqNullSafe(F.col("_was"))).select(key, "field").distinct()
