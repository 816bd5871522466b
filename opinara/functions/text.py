"""Columns that clean, parse and format text."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOMBSTONES = ("[removed]", "[deleted]")
SENTINELS = ("", "Nan", "Null")
#: Replacements of the text normaliser, in their order.
REPLACEMENTS = (("cannot ", "can not "), ("n't ", " n't "), ("n 't ", " n't "), ("ca n't", "can't"), ("ai n't", "ain't"), ("'m ", " 'm "), ("'re ", " 're "), ("'s ", " 's "), ("'ll ", " 'll "), ("'d ", " 'd "), ("'ve ", " 've "), (" p . m .", "  p.m."), (" p . m ", " p.m "), (" a . m .", " a.m."), (" a . m ", " a.m "))


def post_permalink(permalink: Column) -> Column:
    """The part of a comment's link that is its post's."""
    return F.nullif(F.regexp_extract(permalink, r"^(/r/[^/]+/comments/[^/]+/[^/]+/)", 1), F.lit(""))


def parent_of(parent_id: Column) -> Column:
    """The comment a comment answers; posts (t3_) are no comments."""
    return F.when(parent_id.startswith("t1_"), F.nullif(F.regexp_extract(parent_id, r"^t[0-9]_([a-z0-9]+)", 1), F.lit("")))


def unescape_quotes(text: Column) -> Column:
    """Quoted lines between quotation marks."""
    return F.regexp_replace(text, "(?d)&gt;(.*)\n", '"$1"\n')  # only a line feed ends a line


# What a token of a post is, the first that fits: links, emoticons, tags, arrows, users, hashtags, mail, words
# with dashes or apostrophes within, numbers with marks within, other words, rows of dots, single characters.
TOKEN = "|".join((
    r"[hH][tT][tT][pP][sS]?://[^ \t\n\x0B\f\r]+", r"[wW][wW][wW]\.[^ \t\n\x0B\f\r]+",
    r"[<>]?[:;=8][\-o\*']?[\)\]\(\[dDpP/:\}\{@|\\]", r"[\)\]\(\[dDpP/:\}\{@|\\][\-o\*']?[:;=8][<>]?", r"<3",
    r"<[^> \t\n\x0B\f\r]+>", r"-+>|<-+", r"@[A-Za-z0-9_]+", r"#+[\p{L}\p{N}_]+[\p{L}\p{N}_'\-]*[\p{L}\p{N}_]+",
    r"[A-Za-z0-9_.+\-]+@[A-Za-z0-9_\-]+\.[A-Za-z0-9_.\-]*[A-Za-z0-9_\-]",
    r"\p{L}[\p{L}'\-_]+\p{L}", r"[+\-]?[0-9]+[,/.:\-][0-9]+[+\-]?", r"[\p{L}\p{N}_]+", r"\.(?:[ \t\n\x0B\f\r]*\.)+", r"[^ \t\n\x0B\f\r]",
))
#: Blocks of emoji, by first and last code point.
EMOJI = ((0x203C, 0x203C), (0x2049, 0x2049), (0x2139, 0x2139), (0x2194, 0x21AA), (0x231A, 0x23FF), (0x25AA, 0x27BF), (0x2934, 0x2935), (0x2B05, 0x2B55), (0x1F004, 0x1F0CF), (0x1F170, 0x1F251), (0x1F300, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F7E0, 0x1F7F0), (0x1F90C, 0x1FAFF))


def emoji_names() -> dict[str, str]:
    """:name: of each emoji, from its name in Unicode."""
    found = {chr(c): unicodedata.name(chr(c), "") for lo, hi in EMOJI for c in range(lo, hi + 1)}
    return {c: ":" + n.lower().replace(" ", "_") + ":" for c, n in found.items() if n}


def name_emoji(token: Column) -> Column:
    """A token that is an emoji by its name; the table is one constant, and only tokens in the blocks are looked up."""
    table = F.from_json(F.lit(json.dumps(emoji_names())), "map<string,string>")
    blocks = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in EMOJI)
    return F.when(token.rlike(f"^[{blocks}]$"), F.coalesce(F.element_at(table, token), token)).otherwise(token)


def tokens(text: Column) -> Column:
    """The tokens of a text, punctuation apart."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def normalize_token(token: Column) -> Column:
    lower = F.lower(token)
    other = F.when(token == "’", "'").when(token == "…", "...").otherwise(name_emoji(token))
    return F.when(token.startswith("@"), "@USER").when(lower.startswith("http") | lower.startswith("www"), "HTTPURL").otherwise(other)


def normalize(text: Column) -> Column:
    """Tokens replaced and set apart by spaces, contractions set apart, white space collapsed."""
    out = F.array_join(F.transform(tokens(F.replace(F.replace(text, F.lit("’"), F.lit("'")), F.lit("…"), F.lit("..."))), normalize_token), " ")
    for old, new in REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, "[ \n\t]+", " "))


def is_text(text: Column) -> Column:
    """Not null, no sentinel and not white space only."""
    return text.isNotNull() & ~text.isin(*SENTINELS) & ~text.rlike("^[\\s\\uFE0E]+$")


def is_alive(text: Column) -> Column:
    """Not removed by moderation."""
    return ~text.isin(*TOMBSTONES)


def parse_stance(answer: Column) -> Column:
    """The first word of the first line that names a side; neutral without one."""
    words = F.regexp_extract_all(F.lower(F.element_at(F.split(answer, "\n"), 1)), F.lit(r"(\w+)"), F.lit(1))

    def side(w: Column) -> Column:
        against = w.contains("against") | w.contains("disagree")
        favor = (w.contains("favor") | w.contains("agree") | w.contains("support")) & ~w.contains("disagree")
        return F.when(favor, "favor").when(against, "against").when(w.contains("neutral"), "neutral")

    return F.coalesce(F.get(F.filter(F.transform(words, side), lambda s: s.isNotNull()), F.lit(0)), F.lit("neutral"))


def parse_yes_no(answer: Column) -> Column:
    """By the first line: the one of yes and no that stands there alone; else yes if a word of approval does."""
    line = F.lower(F.element_at(F.split(answer, "\n"), 1))
    yes, no = line.contains("yes"), line.contains("no")
    approves = line.contains("favor") | line.contains("agree") | line.contains("support")
    return F.when(yes & ~no, "yes").when(no & ~yes, "no").when(approves, "yes").otherwise("no")


def resolve_two(favor: Column, against: Column) -> Column:
    return F.when((favor == "yes") & (against == "no"), "favor").when((favor == "no") & (against == "yes"), "against").otherwise("neutral")


def choice_suffix(answer: Column, *choices: str) -> Column:
    out = F.lit(None).cast("string")
    for c in reversed(choices):
        out = F.when(answer.endswith(c), c).otherwise(out)
    return out


def fields(completion: Column, *names: str) -> list[Column]:
    """The value after each `Name:` up to the end of its line."""
    return [F.nullif(F.trim(F.regexp_extract(completion, rf"(?m)^{n}:[ \t]*(.*)$", 1)), F.lit("")).alias(n.lower()) for n in names]


def messages(prompt: Column, mark: str = "Stance:") -> Column:
    """A prompt as messages, cut behind its last mark."""
    head = F.regexp_extract(prompt, rf"(?s)^(.*{mark})", 1)
    tail = F.regexp_extract(prompt, rf"(?s)^.*{mark}(.*)$", 1)
    return F.array(F.struct(F.lit("user").alias("role"), head.alias("content")), F.struct(F.lit("assistant").alias("role"), F.trim(tail).alias("content")))


def soft_wrap(text: Column, width: int = 100) -> Column:
    """Line breaks become spaces, then each first space from `width` on becomes a line break."""
    return F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), f"(.{{{width}}}[^ ]*) ", "$1\n")


def slug(text: Column) -> Column:
    return F.translate(text, " /", "__")


def pretty(name: Column) -> Column:
    return F.replace(F.initcap(F.replace(F.regexp_replace(name, "^stance_", ""), F.lit("_"), F.lit(" "))), F.lit("Ndp"), F.lit("NDP"))


def shorten(text: Column, most: int = 30) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def prompt(stance: Column, post: Column, parent: Column, body: Column) -> Column:
    """A labelling prompt; the parent's part is left out where there is none."""
    line = lambda c: F.replace(c, F.lit("\n"), F.lit(" "))
    context = F.when(parent.isNotNull(), F.concat(F.lit("Parent comment: "), line(parent), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("Post: "), line(F.coalesce(post, F.lit(""))), F.lit("\n"), context, F.lit("Comment: "), line(body), F.lit("\nStance on "), stance, F.lit(":"))
