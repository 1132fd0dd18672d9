r"""Operator 2: line-first cleaning and document quality rules, in SQL functions only.

Words are ``[^\x20\x09-\x0D]+``.  Lines are cut at ``\n``; a line with words
fails by a rule on

* navigation: at least ``bars`` of its words are single bars, slashes or
  arrows, or two are and few words stand between them, or it is one of three
  or more short lines in a row that end no sentence (a list of links);
* boilerplate: licence, cookie, rights and subscription phrases;
* punctuation: too many symbols for its length, or an ellipsis at its end
  (a teaser).

Failed lines are removed; a document that loses more than
``max_loss`` of its words to the line rules is rejected.  Base rules come
first: fewer than 50 words, or more than half of the words in repeated
three-word windows.

Null text has no words: all counts are 0 and the base rules fail it.  Very
long texts are handled in their own row, in time linear in their words (a
sort, where windows repeat).  Rows are independent: repeated rows repeat, an
empty table stays empty, other columns pass through untouched unless they
bear the name of an output, which then replaces them, or of a working column
(_w, _h, _s, _p, _lines, _short, _good), which goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS

#: Phrases that mark a boilerplate line, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "we use cookies", "accept cookies", "subscribe to our newsletter", "sign up for our newsletter", "click here",
    "powered by", "lorem ipsum", "javascript is disabled", "enable javascript", "skip to content", "back to top",
    "tous droits réservés", "todos los derechos reservados", "alle rechte vorbehalten",
)
#: Words that stand for a link separator.
BARS = ("|", "»", "›", "•", "·", "::", ">", "→", "/")
SYMBOLS = r"#*$%&|<>"


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def n_words_of(text: Column) -> Column:
    """The number of words, without an array."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def without(text: Column, chars: str) -> Column:
    """The text less some ASCII characters; each is one fast byte search."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


#: Positions (as an array) of the three-word windows of ``_w`` that occur twice or more.  Hashes settle texts without a
#: repeat; the others sort (hash, window, place), so that equal windows stand side by side.
_PLACES = """
CASE WHEN size(_w) < 4 OR size(array_distinct(_h)) = size(_h) THEN array()
ELSE sort_array(transform(sequence(0, size(_w) - 3), i -> struct(_h[i] AS h, concat_ws(' ', _w[i], _w[i + 1], _w[i + 2]) AS t, i AS i))) END
"""
_REPEATED = """
sort_array(transform(filter(sequence(0, greatest(size(_s) - 1, 0)),
    k -> size(_s) > 0 AND ((k > 0 AND _s[greatest(k - 1, 0)].h = _s[k].h AND _s[greatest(k - 1, 0)].t = _s[k].t)
        OR (k < size(_s) - 1 AND _s[least(k + 1, size(_s) - 1)].h = _s[k].h AND _s[least(k + 1, size(_s) - 1)].t = _s[k].t))), k -> _s[k].i))
"""
_COVERED = "aggregate(_p, struct(0L AS n, -3 AS last), (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n)"


def link_like(line: Column, longest: int = 40, words: int = 4) -> Column:
    """Whether a line is short and ends no sentence, as links in a list do."""
    end = f"[.!?…:;,\"')\\]][{SPACE}]*$"
    return (F.length(line) <= longest) & ~line.rlike(end) & (F.regexp_count(line, F.lit(f"[^{SPACE}]+")) <= words)


def line_fails(line: Column, bars: int = 3, max_symbols: float = 0.1) -> Column:
    """Whether a line (with words) fails the navigation, boilerplate or punctuation rule, seen alone."""
    separators = "|".join(f"\\Q{b}\\E" for b in BARS)
    found = F.regexp_count(line, F.lit(f"(?<![^{SPACE}])(?:{separators})(?![^{SPACE}])"))
    few = F.regexp_count(line, F.lit(f"[^{SPACE}]+")) <= 4 * found + 3
    navigation = (found >= 2) & ((found >= bars) | few)  # most lines have no bar and are done after one search
    boilerplate = F.lower(line).rlike("|".join(BOILERPLATE))
    symbols = F.length(line) - F.length(without(line, SYMBOLS))
    end = F.rtrim(line, F.lit(SPACE_CHARS))
    teaser = end.endswith("...") | end.endswith("…")
    return navigation | boilerplate | (symbols > max_symbols * F.length(line)) | teaser


def quality_rules(docs: DataFrame, max_loss: float = 0.5, min_words: int = 50, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_bad_lines, lost_words, cleaned_text, kept."""
    t = F.coalesce(F.col(text), F.lit(""))
    has_word = f"[^{SPACE}]"
    own = ["_w", "_h", "_s", "_p", "_lines", "_short", "_good"]
    df = docs.withColumns({"_w": words_of(F.col(text)), "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(has_word))})
    df = df.withColumns({
        "_h": F.expr("CASE WHEN size(_w) < 3 THEN array() ELSE transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END"),
        "_short": F.transform("_lines", lambda x: link_like(x)),
    })
    at = lambda i: F.element_at("_short", F.greatest(F.lit(1), F.least(i + 1, F.size("_lines"))).cast("int"))
    last = F.size("_lines") - 1
    run = lambda i: at(i) & ((i > 0) & (i < last) & at(i - 1) & at(i + 1) | (i > 1) & at(i - 1) & at(i - 2) | (i < last - 1) & at(i + 1) & at(i + 2))
    df = df.withColumn("_good", F.filter("_lines", lambda x, i: ~line_fails(x) & ~run(i)))
    df = df.withColumn("_s", F.expr(_PLACES)).withColumn("_p", F.expr(_REPEATED))
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(without(t, SPACE_CHARS)).cast("long"),
        "n_symbols": (F.length(t) - F.length(without(t, SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.expr(_COVERED),
        "n_lines": F.size("_lines").cast("long"),
        "n_bad_lines": (F.size("_lines") - F.size("_good")).cast("long"),
        "cleaned_text": F.array_join("_good", "\n"),
    }).drop(*own)
    df = df.withColumn("lost_words", F.col("n_words") - n_words_of(F.col("cleaned_text")))
    found = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "cleaned_text", "lost_words")
    # a generator is a wall: without it, a filter on the result would be rewritten into the array functions, once per element
    df = df.select(*(c for c in df.columns if c not in found), F.inline(F.array(F.struct(*found))))
    df = df.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= max_loss * F.col("n_words")))
