"""Predicates and splits on single tokens, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptmill.functions.mapping import KEY_CLASS, to_cyrillic

# Emoticons that stay as typed, what may begin one, and what ends one.
EMOTICONS = [":D", ":P", ":p", ":O", ":o", ":3", ":X", ":x", ";D", ";P", ";p", "=D", "=P", "=p", ":-D", ":-P", ":-p", ":-O", ":-o", ":-3", ";-D", ";-P", ";-p", ":'D", "xD", "XD", "xP", "XP"]
EMOTICON_PREFIXES = [":", ";", "=", ":-", ";-", "=-", ":'", ";'"]
EMOTICON_BODIES = [")", "(", "*", "|"]
# Applications in which nothing is rewritten.
TERMINAL_APPS = [
    "com.apple.Terminal",
    "com.googlecode.iterm2",
    "net.kovidgoyal.kitty",
    "io.alacritty",
    "com.github.wez.wezterm",
    "dev.warp.Warp-Stable",
    "dev.warp.Warp",
    "co.zeit.hyper",
    "com.qvacua.VimR",
    "org.vim.MacVim",
]
TERMINAL_PREFIXES = ["com.microsoft.VSCode", "com.jetbrains."]

TRAILING = r"[.,!?]*\z"
EMAIL_OR_URL = r"[@/]|\p{N}|[^.]\.+[^.]"
#: Typed characters that only join a token once it has begun.
JOINING = r".@\-_/+0-9"
SEGMENT = rf"[{KEY_CLASS}][{KEY_CLASS}{JOINING}]*"


def is_email_or_url(word: Column) -> Column:
    """Has an at sign, a slash, a digit, or a dot between other characters."""
    return F.coalesce(word.rlike(EMAIL_OR_URL), F.lit(False))


def is_emoticon(word: Column) -> Column:
    return F.coalesce(word.isin(EMOTICONS), F.lit(False))


def is_emoticon_prefix(buffer: Column) -> Column:
    return F.coalesce(buffer.isin(EMOTICON_PREFIXES), F.lit(False))


def is_emoticon_body(char: Column) -> Column:
    return F.coalesce(char.isin(EMOTICON_BODIES), F.lit(False))


def trailing(word: Column) -> Column:
    """The stops at the end of a word: full stop, comma, exclamation and question mark."""
    return F.regexp_extract(word, r"([.,!?]*)\z", 1)


def stem(word: Column) -> Column:
    """The word without them."""
    return F.regexp_replace(word, TRAILING, "")


def by_hyphens(word: Column, each) -> Column:
    """``each`` applied to the parts between hyphens, empty ones kept."""
    return F.array_join(F.transform(F.split(word, "-", -1), each), "-")


def map_token(word: Column) -> Column:
    """Transliterates around hyphens and keeps the stops at the end."""
    return F.concat(by_hyphens(stem(word), to_cyrillic), trailing(word))


def restore_case(word: Column, replacement: Column) -> Column:
    """The replacement, with a capital first letter where the word has one."""
    capital = F.concat(F.upper(F.substring(replacement, 1, 1)), F.expr("''"), F.substring(replacement, F.lit(2), F.length(replacement)))
    return F.when(word.rlike(r"\A\p{Lu}"), capital).otherwise(replacement)


def is_terminal_app(bundle_id: Column) -> Column:
    found = bundle_id.isin(TERMINAL_APPS)
    for prefix in TERMINAL_PREFIXES:
        found = found | bundle_id.startswith(prefix)
    return F.coalesce(found, F.lit(False))


def key_class(char: Column) -> Column:
    """letter, special (types a letter too), joining (of addresses and numbers) or other."""
    return (
        F.when(char.rlike(r"\A[A-Za-z]\z"), "letter")
        .when(char.rlike(rf"\A[{KEY_CLASS}]\z"), "special")
        .when(char.rlike(rf"\A[{JOINING}]\z"), "joining")
        .otherwise("other")
    )


def segments(text: Column) -> Column:
    """Tokens of plain text as the keyboard buffers them."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({SEGMENT})"), 1)
