"""Wildcard patterns as regular expressions, from Python strings or from columns of patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A regular expression that matches nothing.
NOTHING = r"[^\s\S]"


def _quoted(part: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", part)


def topic_regex(pattern: str) -> str:
    """For ``key + '.'``: words between dots; ``*`` is one word, ``#`` any number of them."""
    kinds = {"*": r"[^.]*\.", "#": r"(?:[^.]*\.)*"}
    return "^" + "".join(kinds.get(w, _quoted(w) + r"\.") for w in pattern.split(".")) + "$"


def mqtt_regex(pattern: str) -> str:
    """For ``topic + '/'``: levels between slashes; ``+`` is one level, the first ``#`` matches the rest:
    at least one level, unless nothing but ``#`` follows it."""
    out = "^"
    parts = pattern.split("/")
    for i, part in enumerate(parts):
        if part == "#":
            return out + ("(?:[^/]*/)*$" if all(p == "#" for p in parts[i:]) else "(?:[^/]*/)+$")
        out += "[^/]*/" if part == "+" else _quoted(part) + "/"
    return out + "$"


def glob_regex(pattern: str) -> str:
    """File-name globbing: ``*`` a run without slash, ``?`` one such character, ``[...]`` a class; a class
    that never ends matches nothing.  ``*`` alone is any name, and ``x.*`` also takes one word with slashes."""
    if pattern == "*":
        return r"^[\s\S]*$"
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += _quoted(pattern[i])
        elif c == "[":
            m = re.compile(r"\[(\^?)((?:\\.|[^\]\\])+)\]", re.S).match(pattern, i)
            if m is None:
                out = NOTHING
                break
            out += "[" + m[1] + re.sub(r"\\([A-Za-z0-9_])", r"\1", m[2]).replace("[", r"\[") + "]"
            i = m.end() - 1
        else:
            out += _quoted(c)
        i += 1
    word = "|" + _quoted(pattern[:-1]) + "[^.]*" if pattern.endswith(".*") else ""
    return f"^(?:{out}{word})$"


def _quote(part: Column) -> Column:
    return F.regexp_replace(part, r"([^A-Za-z0-9_])", r"\\$1")


def topic_matches(pattern: Column, key: Column) -> Column:
    """Whether a dotted key matches a topic pattern; both are columns."""
    words = F.transform(
        F.split(pattern, r"\."),
        lambda w: F.when(w == "*", F.lit(r"[^.]*\.")).when(w == "#", F.lit(r"(?:[^.]*\.)*")).otherwise(F.concat(_quote(w), F.lit(r"\."))),
    )
    return F.rlike(F.concat(key, F.lit(".")), F.concat(F.lit("^"), F.array_join(words, ""), F.lit("$")))


def mqtt_matches(pattern: Column, topic: Column) -> Column:
    """Whether a topic matches an MQTT filter; both are columns."""
    levels = F.split(pattern, "/")
    first = F.array_position(levels, "#")
    before = F.when(first > 0, F.slice(levels, 1, (first - 1).cast("int"))).otherwise(levels)
    rest = F.when(first > 0, F.slice(levels, first.cast("int"), F.size(levels))).otherwise(F.array().cast("array<string>"))
    head = F.array_join(F.transform(before, lambda x: F.when(x == "+", F.lit("[^/]*/")).otherwise(F.concat(_quote(x), F.lit("/")))), "")
    tail = F.when(first == 0, F.lit("")).when(F.forall(rest, lambda x: x == "#"), F.lit("(?:[^/]*/)*")).otherwise(F.lit("(?:[^/]*/)+"))
    return F.rlike(F.concat(topic, F.lit("/")), F.concat(F.lit("^"), head, tail, F.lit("$")))


def glob_matches(pattern: Column, name: Column) -> Column:
    """Whether a name matches a glob of ``*``, ``?``, ``[...]`` and ``\\x``, or equals it; both are columns.

    A class that never ends matches nothing.
    """
    parts = F.regexp_extract_all(pattern, F.lit(r"(?s)\\.|\[\^?[^\]\\](?:\\.|[^\]\\])*\]|\[\^?(?:\\.)(?:\\.|[^\]\\])*\]|."), F.lit(0))
    inside = lambda w: F.regexp_replace(F.regexp_replace(F.substr(w, F.lit(2), F.length(w) - 2), r"\\([A-Za-z0-9_])", "$1"), r"([\[&~])", r"\\$1")
    regex = F.transform(
        parts,
        lambda w: F.when(w == "*", F.lit("[^/]*"))
        .when(w == "?", F.lit("[^/]"))
        .when(F.startswith(w, F.lit("\\")) & (F.length(w) == 2), _quote(F.substr(w, F.lit(2), F.lit(1))))
        .when(F.startswith(w, F.lit("[")) & (F.length(w) > 1), F.concat(F.lit("["), inside(w), F.lit("]")))
        .otherwise(_quote(w)),
    )
    broken = F.exists(parts, lambda w: w == "[")
    globbed = F.rlike(name, F.when(broken, F.lit(NOTHING)).otherwise(F.concat(F.lit("(?s)^"), F.array_join(regex, ""), F.lit("$"))))
    word = F.substr(pattern, F.lit(1), F.length(pattern) - 1)  # of "x.*": any one word, slashes and all
    dotted = F.endswith(pattern, F.lit(".*")) & F.startswith(name, word) & (F.instr(F.substr(name, F.length(pattern)), ".") == 0)
    return (pattern == "*") | (pattern == name) | globbed | dotted


def to_log_topic(topic: Column, separator: str = ".") -> Column:
    return F.replace(topic, F.lit("/"), F.lit(separator))


def to_mqtt_topic(topic: Column, separator: str = ".") -> Column:
    return F.replace(topic, F.lit(separator), F.lit("/"))
