"""Text columns: cleaning, script statistics, labels, titles and plans. All are built-in expressions but part of NFKC."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.compat import nfkc

#: The invisible direction marks that are removed.
BIDI = "\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
#: Arabic letters and their presentation forms, as regular expression classes.
ARABIC = r"\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF"
FORMS = r"\uFB50-\uFDFF\uFE70-\uFEFF"
#: White space, as the Unicode property has it, inside a class.
WHITE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The healthy band of spaces a character.
SPACES_LOW, SPACES_HIGH = 0.13, 0.22
EDGE_SIGNS = ".,،؛;:!?()[]{}«»\"'-—…"

#: Words that alone ask for nothing, English then Arabic (without marks).
SMALL_TALK = (
    "hi hello hey hiya yo good morning afternoon evening night thanks thank you thx ty much so very a lot lots for the "
    "help your great nice awesome perfect cool ok okay got it sure bye goodbye see later cheers there all that was "
    "helpful job work sorry welcome appreciate it's "
    "مرحبا اهلا أهلا السلام عليكم وعليكم صباح مساء الخير النور شكرا جزيلا جزاك الله خيرا تمام حسنا ممتاز رائع فهمت مع "
    "السلامة وداعا عفوا لك كثيرا على المساعدة أشكرك"
).split()

#: Words that head a figure or table label, and the kind they name.
LABEL_KINDS = {
    "fig": "figure", "figure": "figure", "شكل": "figure", "رسم": "figure", "مخطط": "figure", "diagram": "figure", "chart": "figure",
    "plate": "figure", "exhibit": "figure", "map": "figure", "صورة": "figure", "table": "table", "جدول": "table",
}


def _label_pattern() -> str:
    """A word of the table (a Latin one from a word's start and perhaps with a full stop, an Arabic one perhaps with the article), its number and one letter."""
    latin, arabic = ("|".join(sorted((w for w in LABEL_KINDS if w.isascii() == ascii_), key=len, reverse=True)) for ascii_ in (True, False))
    return rf"(?i)(?:\b({latin})\.?\s*|(?:ال)?({arabic})\s*)([{_DIGITS_TO[:10]}{_DIGITS_FROM}]+)([a-zء-ي]?)"


_DIGITS_FROM, _DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"


def normalize_text(text: Column) -> Column:
    """TXT1: NFKC, no direction marks, runs of blanks as one space."""
    return F.regexp_replace(F.translate(nfkc(text), BIDI, ""), r"[ \t\u00A0]+", " ")


def strip_nulls(value: Column, kind: T.DataType | None = None) -> Column:
    """TXT2: without U+0000 in strings, at any depth of arrays, maps and structs."""
    kind = kind or T.StringType()
    if isinstance(kind, T.StringType):
        return F.replace(value, F.lit("\0"), F.lit(""))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: strip_nulls(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: strip_nulls(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(strip_nulls(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return value


def sanitize(df: DataFrame, column: str = "text") -> DataFrame:
    """TXT3: normalised text without nulls, and flags of what was changed."""
    bare = strip_nulls(F.col(column))
    clean = normalize_text(bare)
    return df.withColumns({"clean": clean, "had_nulls": F.col(column).contains("\0"), "reshaped": bare != clean})


def _removed(text: Column, kind: str) -> Column:
    # Runs of a class are taken out as one match each, and what is missing then is counted; no list of matches is made.
    return F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))


def script_counts(text: Column) -> dict[str, Column]:
    """TXT4: counts of a text's characters by script and kind, by name."""
    text = F.coalesce(text, F.lit(""))
    # Plain spaces, most of the white space, go by a byte search; a pattern then meets few.
    spaces = F.length(text) - F.length(F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), f"[{WHITE}]+", ""))
    return {
        "characters": F.length(text), "arabic": _removed(text, rf"[{ARABIC}&&[^\p{{Nd}}]]"),
        "latin": _removed(text, rf"[\p{{L}}&&[^{ARABIC}{FORMS}]]"), "digits": _removed(text, rf"[\p{{Nd}}&&[^{FORMS}]]"),
        "forms": _removed(text, f"[{FORMS}]"), "bidi": _removed(text, f"[{BIDI}]"), "spaces": spaces,
        "words": F.length(F.regexp_replace(text, f"[^{WHITE}]+", "x")) - spaces,
    }


def script_profile(text: Column) -> Column:
    """TXT4: the counts as one struct."""
    return F.struct(*(c.alias(name) for name, c in script_counts(text).items()))


def with_usability(df: DataFrame, text: str = "text") -> DataFrame:
    """TXT5 of a text column, as columns. Counts are columns below them: each is made once, or not at all where nothing asks for it."""
    counts = script_counts(F.col(text))
    counted = df.withColumns({f"_{name}": c for name, c in counts.items()})
    return counted.withColumns(_judged(SimpleNamespace(**{name: F.col(f"_{name}") for name in counts}))).drop(*(f"_{name}" for name in counts))


def usability(profile: Column) -> Column:
    """TXT5: ratios and flags of a script profile; only texts over 80 characters are judged by their spaces."""
    return F.struct(*(c.alias(name) for name, c in _judged(profile).items()))


def _judged(profile: Column | SimpleNamespace) -> dict[str, Column]:
    letters = profile.arabic + profile.latin + profile.forms
    arabic = F.when(letters > 0, (profile.arabic + profile.forms) / letters).otherwise(F.lit(0.0))
    spaces = F.when(profile.characters > 0, profile.spaces / profile.characters).otherwise(F.lit(0.0))
    long = profile.characters > 80
    fragmented, together = long & (spaces > SPACES_HIGH), long & (spaces < SPACES_LOW)
    return {"arabic_ratio": arabic, "is_arabic": arabic >= 0.5, "space_ratio": spaces, "fragmented": fragmented,
            "run_together": together, "usable": ~fragmented & ~together, "needs_normalization": (profile.forms > 0) | (profile.bidi > 0)}


def word_ratio(text: Column) -> Column:
    """TXT6: real words (three letters or more, edge signs aside) and their share of the tokens with a letter."""
    edge = "[" + "".join("\\" + c for c in EDGE_SIGNS) + "]+"
    tokens = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"), 0), lambda t: t.rlike(r"[\p{L}\p{M}]"))
    core = F.transform(tokens, lambda t: F.regexp_replace(t, f"^{edge}|{edge}$", ""))
    words = F.size(F.filter(core, lambda c: c.rlike(r"^[\p{L}\p{M}\-'’]+$") & (F.length(F.regexp_replace(c, r"[\-'’]", "")) >= 3)))
    return F.struct(words.alias("words"), F.when(F.size(tokens) > 0, words / F.size(tokens)).otherwise(F.lit(0.0)).alias("ratio"))


def reads_as_text(text: Column) -> Column:
    """TXT7: two real words or more, and at least half of the lettered tokens."""
    found = word_ratio(text)
    return (found.words >= 2) & (found.ratio >= 0.5)


def is_small_talk(text: Column) -> Column:
    """TXT8: one to eight words, all of the small-talk list, and no question mark."""
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[\u064B-\u065F\u0670]", "")
    words = F.regexp_extract_all(low, F.lit(r"\p{L}+(?:'[a-z]+)?"), 0)
    known = F.size(F.array_except(words, F.array(*map(F.lit, SMALL_TALK)))) == 0
    return ~low.rlike("[?؟]") & F.size(words).between(1, 8) & known


def labels_in(text: Column) -> Column:
    """TXT9: the figure and table labels that a text names, as distinct (kind, number).

    A text is searched once; what was found, which the pattern matches alone as it did in its text, is taken apart at once.
    """
    pattern = _label_pattern()
    kinds = F.create_map(*(F.lit(x) for pair in LABEL_KINDS.items() for x in pair))
    parts = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0), lambda m: F.lower(F.regexp_replace(m, pattern, "$1$2\n$3$4")))
    return F.array_distinct(F.transform(parts, lambda p: F.struct(
        kinds[F.substring_index(p, "\n", 1)].alias("kind"), F.translate(F.substring_index(p, "\n", -1), _DIGITS_FROM, _DIGITS_TO).alias("number"))))


def squeezed(text: Column) -> Column:
    """One space between words, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def casefold(text: Column) -> Column:
    """Lower case for comparison; the sharp s counts as two."""
    return F.lower(F.regexp_replace(text, "[ßẞ]", "ss"))


def distinct_queries(queries: Column, most: int) -> Column:
    """TXT10: squeezed, not blank, first of each spelling whatever its case, at most so many."""
    clean = F.filter(F.transform(F.coalesce(queries, F.array().cast("array<string>")), squeezed), lambda q: q != "")
    keep = F.aggregate(clean, F.array().cast("array<string>"), lambda out, q: F.when(
        F.exists(out, lambda o: casefold(o) == casefold(q)), out).otherwise(F.array_append(out, q)))
    return F.slice(keep, 1, most)


def with_question(queries: Column, question: Column) -> Column:
    """TXT11: the question itself beside queries of which none shares its script."""
    arabic = r"[\u0621-\u064A\u0671-\u06D3]"
    same = F.exists(queries, lambda q: q.rlike(arabic) == question.rlike(arabic))
    return F.when((F.coalesce(question, F.lit("")) == "") | same, queries).otherwise(F.array_append(queries, question))


def plan(intent: Column, standalone: Column, queries: Column, question: Column, most: int = 4) -> Column:
    """TXT12: small talk has no queries, several queries are complex, else simple; none falls back on the question."""
    alone = F.coalesce(F.nullif(squeezed(standalone), F.lit("")), question)
    found = distinct_queries(queries, most)
    found = F.when(intent == "chitchat", F.array().cast("array<string>")).when(F.size(found) == 0, F.array(alone)).otherwise(found)
    return F.struct(F.when(intent == "chitchat", "chitchat").when(F.size(found) > 1, "complex").otherwise("simple").alias("intent"), alone.alias("standalone_query"), found.alias("sub_queries"))


def time_label(seconds: Column) -> Column:
    """TXT14: m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("bigint")
    minute, second = F.floor(s / 60), s % 60
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), second)).otherwise(F.format_string("%d:%02d", minute, second))


def accepted(original: Column, new: Column, low: float = 0.5, high: float = 2.0) -> Column:
    """TXT15: whether a replacement's length is within the band, and the scale from new to original places."""
    ratio = F.length(new) / F.length(original)
    ok = F.coalesce(F.trim(new) != "", F.lit(False)) & ratio.between(low, high)
    return F.struct(ok.alias("accepted"), F.when(ok, F.length(original) / F.length(new)).otherwise(F.lit(1.0)).alias("scale"))


def title_of(text: Column, most: int = 60) -> Column:
    """TXT16: the first characters of a squeezed text."""
    return F.substring(squeezed(text), 1, most)


def normal_option(text: Column) -> Column:
    """TXT17: an answer option without signs, in lower case, squeezed."""
    return squeezed(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""))


def valid_quiz(question: Column, correct: Column, wrong: Column) -> Column:
    """TXT17: question present, no option empty, a question itself or the question, and four distinct options."""
    options = F.concat(F.array(correct), wrong)
    normal = F.transform(options, normal_option)
    return (
        (F.trim(question) != "") & (F.size(options) == 4) & ~F.exists(normal, lambda o: o == "") & ~F.exists(options, lambda o: F.trim(o).endswith("?"))
        & ~F.array_contains(normal, normal_option(question)) & (F.size(F.array_distinct(normal)) == 4)
    )


def prompt_item(text: Column, context: Column, first: int = 4000, last: int = 1500) -> Column:
    """TXT19: the head of a text and the tail of its context."""
    return F.struct(F.substring(text, 1, first).alias("text"), F.right(context, F.lit(last)).alias("context"))


def is_named(text: Column) -> Column:
    """TXT20: not null and not blank."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) != "", F.lit(False))


def skips_correction(kind: Column, source_url: Column, native: tuple = ("txt", "md", "csv", "xlsx")) -> Column:
    """TXT21: text-native types and fetched links are not corrected."""
    return kind.isin(*native) | (F.length(F.coalesce(source_url, F.lit(""))) > 0)


def command_text(message: Column, command: str = "/memory") -> Column:
    """TXT22: what follows a command, null where there is none."""
    bare = F.trim(message)
    return F.when(F.lower(bare).startswith(command), F.trim(F.right(bare, F.length(bare) - len(command))))
