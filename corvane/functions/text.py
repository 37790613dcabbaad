"""Column expressions on text: all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of one line, in Unicode's sense.
BLANK = r"[\s\x{85}\p{Z}]"

_STOP = "a an as at be by if in is it of on or to and are but for its the was why from that were what with"
EVAL_STOP = f"{_STOP} you when your where which".split()
DIFF_STOP = f"{_STOP} do did has have".split()


def strings(words: list[str] | tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def trimmed(text: Column) -> Column:
    """Without white space at either end, tabs, line ends and Unicode spaces included."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def trimmed_right(text: Column) -> Column:
    return F.regexp_replace(text, rf"{BLANK}+$", "")


def normalized(text: Column) -> Column:
    """Lines without white space or byte-order marks at their ends, blank lines never in a row, the whole trimmed."""
    lines = F.transform(F.split(F.regexp_replace(text, r"\r\n", "\n"), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, rf"{BLANK}+$", ""), r"^\x{FEFF}+|\x{FEFF}+$", ""))
    return trimmed(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def title_of(text: Column) -> Column:
    """The first line that isn't blank, without its heading marks; null where there is none."""
    line = trimmed(F.regexp_extract(text, rf"(?m)^{BLANK}*([^\s\x{{85}}\p{{Z}}].*)$", 1))
    return F.when(line != "", trimmed(F.regexp_replace(line, "^#+", "")))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, rf"{BLANK}+"), lambda x: x != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def terms(text: Column) -> Column:
    """The set of lower-cased ASCII letter and digit runs of two or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: F.length(x) >= 2))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda x: x != "")


def token_set(text: Column, stop: list[str]) -> Column:
    return F.array_except(tokens(text), strings(stop))


def chunk_sentences(text: Column) -> Column:
    """Cut after . ! ? ; where white space or the end follows."""
    return F.filter(F.transform(F.split(text, rf"(?<=[.!?;])(?={BLANK}|$)"), trimmed), lambda x: x != "")


def claim_sentences(text: Column) -> Column:
    """Cut after each . ! ?, whatever follows."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])"), trimmed), lambda x: x != "")


def heading_path(line: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(line, "^#+", ""), "/"), trimmed), lambda x: x != "")


def n_headings(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^[^\S\n]*#"))


def ends_mid_sentence(text: Column) -> Column:
    """Whether the last sentence seems to be cut off."""
    t = trimmed_right(text)
    last = F.right(t, F.lit(1))
    after = F.regexp_extract(F.right(t, F.lit(200)), rf"[.!?]{BLANK}*([^\s.!?])[^.!?]*$", 1)
    return (
        F.when(t == "", False)
        .when(last.isin(".", "!", "?", "»", "”"), False)
        .when(last.isin(",", ";", ":"), True)
        .otherwise(~after.rlike(r"^\p{IsUppercase}"))
    )


def overlap_of(a: Column, b: Column, limit: int = 200) -> Column:
    """The most words, up to the limit, that end the word list a and begin the word list b.

    Lists are compared only where their first words are equal.
    """
    most = F.least(F.size(a), F.size(b), F.lit(limit))
    begins = F.filter(F.sequence(most, F.lit(1), F.lit(-1)), lambda k: F.get(a, F.size(a) - k) == F.get(b, 0))
    fits = F.filter(begins, lambda k: F.slice(a, -k, k) == F.slice(b, 1, k))
    return F.when(most <= 0, 0).otherwise(F.coalesce(F.get(fits, 0), F.lit(0)))


def overlap_share(a: Column, b: Column) -> Column:
    """The share of the set a that is in b; 0 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def squeezed(text: Column) -> Column:
    """Lower-cased, each run of white space one space."""
    return F.lower(F.array_join(words(text), " "))


def bare_id(text: Column) -> Column:
    """Letters and digits alone, lower-cased; where there are none, the trimmed text."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]", "")
    return F.when(bare != "", bare).otherwise(F.lower(trimmed(text)))


def preview(text: Column, most: int = 220) -> Column:
    """At most so many characters, and dots if more followed."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def summary(text: Column, most: int = 120) -> Column:
    """On one line, at most so many characters, the dots included."""
    line = F.array_join(words(text), " ")
    return F.when(F.char_length(line) > most, F.concat(F.left(line, F.lit(most - 3)), F.lit("..."))).otherwise(line)


def mentions(answer_tokens: Column, value: Column) -> Column:
    """Whether a text, as tokens, names a value: as a phrase, or with all its tokens anywhere.

    A value of one or two letters must be a token of its own.
    """
    own = tokens(value)
    padded = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    short = (F.octet_length(trimmed(value)) <= 2) & trimmed(value).rlike("^[A-Za-z]+$")
    phrase = F.contains(padded(answer_tokens), padded(own))
    return F.when(F.size(own) == 0, False).when(short, F.array_contains(answer_tokens, F.lower(trimmed(value)))).otherwise(phrase | F.forall(own, lambda t: F.array_contains(answer_tokens, t)))


AUDIT_UP = "increase increased growth grew up rise rising higher".split()
AUDIT_DOWN = "decrease decreased decline declined down drop dropped lower fell falling".split()
DIFF_UP = "increase increased growth grew higher up".split()
DIFF_DOWN = "decrease decreased decline declined lower down drop dropped fell".split()


def direction(token_list: Column, up: list[str], down: list[str]) -> Column:
    """'up' or 'down' where the words of one direction alone occur, else 'unknown'."""
    rises, falls = F.arrays_overlap(token_list, strings(up)), F.arrays_overlap(token_list, strings(down))
    return F.when(rises & ~falls, "up").when(falls & ~rises, "down").otherwise("unknown")


def page_slug(url: Column) -> Column:
    """A file name for a URL: host and path joined, other characters as underscores, 180 at most before the ending."""
    host = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), ":", "_")
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    named = F.concat(host, F.lit("_"), F.when(path == "", "index").otherwise(F.replace(path, F.lit("/"), F.lit("_"))))
    return F.concat(F.left(F.regexp_replace(named, r"[^0-9A-Za-z_.-]+", "_"), F.lit(180)), F.lit(".txt"))
