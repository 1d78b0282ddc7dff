"""Text quality of recognised screen text, as built-in expressions.

Everything is a ``Column``; nothing here needs Python on an executor.  Longer
rules come as functions that add columns to a DataFrame, so that a token list is
computed once per row however often it is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns, word lists and character sets of the text rules.
ARTIFACTS = r"[«»©®™•¤§|`~^*_=<>{}\[\]\\‘’“”\x00-\x1f]"
SPACES = r"[\s\p{Z}]+"
ENDS = " .,;:-"
TOKEN_ENDS = ".,;:!?()\"'"
TIME_TOKEN = r"^[^\p{L}\p{N}_]*[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?[^\p{L}\p{N}_]*$"
TIME_INSIDE = r"(^|[^\p{L}\p{N}_])[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?([^\p{L}\p{N}_]|$)"
DOMAIN = r"^[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}(/[^\s]*)?$"
EMAIL = r"^[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[A-Za-z]{2,}$"
NUMBER = r"^[+-]?[0-9][0-9,.]*%?$"
#: What most tokens are: letters and nothing else. Where these are ASCII, size and vowels decide; else no class but junk is left.
LETTERS = r"^\p{L}+$"
ASCII_LETTERS = r"^[A-Za-z]+$"
WORD = r"^[A-Za-z][A-Za-z'&.-]*$"
WORD_DIGITS = r"^[A-Za-z]+[0-9]{1,6}$"
SHORT_WORDS = "ok on in to of at go no up or if my we he it is as an am do be by".split()
GLYPH_WORDS = "ull ul ules ies wll atl lte volte 5g 4g 3g".split()
CLOCK_REST = 10


def clean(text: Column) -> Column:
    """Artifact and control characters to blanks, blanks collapsed, ends stripped."""
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), ARTIFACTS, " ")
    return F.btrim(F.regexp_replace(blank, SPACES, " "), F.lit(ENDS))


def tokens(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def bare(token: Column) -> Column:
    return F.btrim(token, F.lit(TOKEN_ENDS))


def is_address(token: Column) -> Column:
    # The first test is cheap and settles most tokens.
    return (token.contains(".") | token.contains("@")) & (token.rlike(DOMAIN) | token.rlike(EMAIL))


def bound(value: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule(value)`` with the value computed once, however often the rule names it."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def kind(token: Column) -> Column:
    """time, domain, number, word or junk."""

    def rated(b: Column) -> Column:
        return F.when(b.rlike(ASCII_LETTERS), F.when(_is_word(b), "word").otherwise("junk")).when(b.rlike(LETTERS), "junk").otherwise(_kind(b))

    return bound(bare(token), rated)


def _is_word(b: Column) -> Column:
    """Of a token of letters (and marks inside): long with a vowel, short capitals, or a known short word."""
    low, size, caps = F.lower(b), F.length(b), b == F.upper(b)
    long_word = low.rlike("[aeiouy]") | (caps & (size <= 5))
    short_word = low.isin(SHORT_WORDS) | (caps & (size == 2) & b.rlike("^[A-Z]"))
    return F.when(size >= 3, long_word & ~low.isin(GLYPH_WORDS)).otherwise(short_word & ~low.isin(GLYPH_WORDS))


def _kind(b: Column) -> Column:
    letters = F.regexp_replace(F.lower(b), "[0-9]", "")
    return (
        F.when(b == "", "junk")
        .when(b.rlike(TIME_TOKEN), "time")
        .when(is_address(b), "domain")
        .when(b.rlike(NUMBER), "number")
        .when(b.rlike(WORD_DIGITS), F.when((F.length(letters) >= 3) & letters.rlike("[aeiouy]"), "word").otherwise("junk"))
        .when(b.rlike(WORD) & _is_word(b), "word")
        .otherwise("junk")
    )


def settled(parts: Column, raw: Column) -> Column:
    """Kind and size of every token; a short word that repeats its neighbour is junk."""

    def one(token: Column, i: Column) -> Column:
        low = F.lower(token)
        # get() is null outside of the list
        stutter = F.coalesce(F.lower(F.get(parts, i - 1)) == low, F.lit(False)) | F.coalesce(F.lower(F.get(parts, i + 1)) == low, F.lit(False))
        size, of = F.length(token), F.get(raw, i)
        return F.struct(F.when((size <= 3) & (of == "word") & stutter, "junk").otherwise(of).alias("kind"), size.alias("n"))

    return F.transform(parts, one)


def _chars(pairs: Column, of: str) -> Column:
    return F.aggregate(pairs, F.lit(0), lambda n, p: F.when(p["kind"] == of, n + p["n"]).otherwise(n))


def quality_of(cleaned: Column, pairs: Column) -> Column:
    """0 to 1: how usable a cleaned text is as a label.

    Only characters of words, junk and numbers are summed for every text; what
    the rarer rules ask is looked up where they are reached.
    """
    holds = lambda of: F.exists(pairs, lambda p: p["kind"] == of)
    n = lambda of: F.size(F.filter(pairs, lambda p: p["kind"] == of))

    def rated(t: Column) -> Column:
        total = F.length(cleaned) - F.size(pairs) + 1  # tokens stand one blank apart
        return (
            F.when(holds("time") & (t["word"] < CLOCK_REST), 0.0)
            .when(t["junk"] > t["word"], 0.0)
            .when(t["word"] == 0, F.when((n("number") == 1) & (F.length(cleaned) <= 10) & ~holds("junk"), 0.5).otherwise(0.0))
            .when((t["word"] <= 3) & (n("word") == 1) & holds("junk"), 0.0)
            .otherwise(F.round(F.least(F.lit(1.0), (t["word"] + 0.5 * _chars(pairs, "number")) / F.greatest(total, F.lit(1))), 3))
        )

    sums = F.struct(_chars(pairs, "word").alias("word"), _chars(pairs, "junk").alias("junk"))
    return F.when(F.length(cleaned) < 2, 0.0).when(holds("domain"), 0.9).otherwise(bound(sums, rated))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    A plain ``withColumn`` may be inlined into every later use, filters pushed
    below it included, which multiplies nested rules; a one-row generator is not.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def with_quality(df: DataFrame, text: str, prefix: str = "q_") -> DataFrame:
    """Add ``clean``, ``tokens``, ``raw`` (kinds of tokens by themselves), ``kinds`` and ``quality`` of a text column, prefixed."""
    c, t, r, k, q = (prefix + n for n in ("clean", "tokens", "raw", "kinds", "quality"))
    df = computed(df, c, clean(F.col(text)))
    df = computed(df, t, tokens(F.col(c)))
    df = computed(df, r, F.transform(t, kind))
    df = computed(df, k, settled(F.col(t), F.col(r)))
    return computed(df, q, quality_of(F.col(c), F.col(k)))


def shorten(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most - 3))), F.lit("..."))).otherwise(text)


def with_label(df: DataFrame, text: str, out: str = "label", most: int = 60, prefix: str = "q_") -> DataFrame:
    """Add a printable label, '' where the text is not fit to be shown.

    An address among the tokens wins; else junk is trimmed from both ends of a
    readable text, which must still be readable.
    """
    own = df.columns
    df = with_quality(df, text, prefix)
    t, raw, quality = F.col(prefix + "tokens"), F.col(prefix + "raw"), F.col(prefix + "quality")
    # Addresses are the tokens of kind domain.
    df = computed(df, prefix + "url", F.when(F.array_contains(raw, "domain"), bare(F.get(t, F.array_position(raw, "domain").cast("int") - 1))))
    good = F.transform(raw, lambda k: k != "junk")
    ends = F.struct(F.array_position(good, F.lit(True)).alias("first"), (F.size(raw) - F.array_position(F.reverse(good), F.lit(True)) + 1).alias("last"))
    asked = F.col(prefix + "url").isNull() & (quality >= 0.5)
    df = computed(df, prefix + "ends", F.when(asked, ends))
    first, last = F.col(prefix + "ends.first").cast("int"), F.col(prefix + "ends.last").cast("int")
    cut = (first > 0) & ((first > 1) | (last < F.size(t)))
    # A text that loses nothing is as good as before.
    middle = F.when(cut, F.array_join(F.slice(t, first, last - first + 1), " "))
    df = with_quality(computed(df, prefix + "middle", middle), prefix + "middle", prefix + "m_")
    trimmed = F.col(prefix + "middle").isNotNull()
    readable = F.when(trimmed, F.col(prefix + "m_quality")).otherwise(quality) >= 0.5
    kept = F.when(trimmed, F.col(prefix + "middle")).otherwise(F.col(prefix + "clean"))
    chosen = F.when(F.col(prefix + "url").isNotNull(), F.col(prefix + "url")).when((first > 0) & readable, kept).otherwise("")
    return computed(df, out, shorten(chosen, most)).select(*[c for c in own if c != out], out)


def clock_like(cleaned: Column) -> Column:
    """A time of day with little else: a status bar."""
    # Two passes, since neighbouring times share the character between them.
    rest = F.regexp_replace(F.regexp_replace(cleaned, TIME_INSIDE, "$1 $3"), TIME_INSIDE, "$1 $3")
    words = F.filter(tokens(rest), lambda t: (kind(t) == "word") & ~F.lower(t).isin("am", "pm"))
    size = F.aggregate(words, F.lit(0), lambda a, t: a + F.length(t))
    return cleaned.rlike(TIME_INSIDE) & (size < CLOCK_REST)


def regular_caps(token: Column) -> Column:
    b = F.regexp_replace(token, r"[^\p{L}]", "")
    return b.rlike(r"^(\p{Ll}*|\p{Lu}+|\p{Lu}\p{Ll}*)$")


def typed_ok(cleaned: Column, parts: Column, quality: Column) -> Column:
    """Text that a person may have typed: no clock, no logo, no ticker."""
    letters = F.length(F.regexp_replace(cleaned, r"[^\p{L}]", ""))
    digits = F.length(F.regexp_replace(cleaned, r"[^0-9]", ""))
    code = (digits >= 3) & (letters == 0) & (F.length(cleaned) <= 20)
    prose = (letters >= 3) & F.forall(parts, regular_caps) & (quality >= 0.65)
    return (F.length(cleaned) >= 3) & ~cleaned.rlike(TIME_INSIDE) & (code | prose)


def role(text: str, x: Column, y: Column, w: Column, h: Column, frame_h: Column, frame_w: Column, cleaned: Column, quality: Column) -> Column:
    """status_bar, url_bar, title_bar, button_like or body by place and shape."""
    raw = F.coalesce(F.col(text), F.lit(""))
    url_shaped = raw.contains("/") | raw.startswith("http") | raw.startswith("www.") | F.split(raw, " ")[0].contains(".")
    top = F.when(clock_like(cleaned) | (quality < 0.5), "status_bar").when(url_shaped, "url_bar").otherwise("title_bar")
    domain = F.exists(F.filter(F.split(raw, SPACES), lambda t: t != ""), lambda t: bare(t).rlike(DOMAIN))
    return (
        F.when(y < frame_h * 0.06, top)
        .when((y < frame_h * 0.16) & domain, "url_bar")
        .when(y + h > frame_h * 0.95, "status_bar")
        .when((F.length(raw) <= 24) & (w < frame_w * 0.25) & (h < frame_h * 0.06), "button_like")
        .otherwise("body")
    )
