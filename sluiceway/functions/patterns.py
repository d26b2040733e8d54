"""Field patterns: Perl-style regular expressions with named groups, made ready for Spark.

Spark matches with Java's engine. Named groups become plain groups with a list
of names kept beside them, and the few constructs the two dialects read
differently are rewritten. What Java cannot express is refused with a message.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sluiceway.config import ConfigError

# Bracket classes and their Java names.
POSIX_CLASSES = {
    "alnum": r"\p{Alnum}",
    "alpha": r"\p{Alpha}",
    "ascii": r"\p{ASCII}",
    "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}",
    "digit": r"\p{Digit}",
    "graph": r"\p{Graph}",
    "lower": r"\p{Lower}",
    "print": r"\p{Print}",
    "punct": r"\p{Punct}",
    "space": r"\s",
    "upper": r"\p{Upper}",
    "word": r"\w",
    "xdigit": r"\p{XDigit}",
}

# Java's \b looks at Unicode letters, ours at ASCII words as \w does.
WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
NO_WORD_EDGE = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"

_NAMED_OPEN = re.compile(r"\(\?(?:P?<([A-Za-z_]\w*)>|'([A-Za-z_]\w*)')")
_NAMED_BACK = re.compile(r"\\k(?:<(\w+)>|\{(\w+)\}|'(\w+)')|\(\?P=(\w+)\)")
_NUMBER_BACK = re.compile(r"\\(?:g\{(-?\d+)\}|g(-?\d+)|([1-9]\d*))")
_FLAGS_OPEN = re.compile(r"\(\?[ims]*(?:-[ims]+)?:|\(\?[=!>]|\(\?<[=!]")
_FLAGS_SET = re.compile(r"\(\?[ims]*(?:-[ims]+)?\)")
_QUANTIFIER = re.compile(r"\{\d+(?:,\d*)?\}")
_ZERO_TIMES = re.compile(r"[?*]|\{0")
_PLAIN_ESCAPE = re.compile(r"\\(?:x\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]{2}|0[0-7]{0,2}|c.|[pP]\{[^}]*\}|[pP].|.)", re.S)


@dataclass(frozen=True)
class FieldPattern:
    """A pattern ready for Spark.

    ``java`` is the pattern with plain groups, ``marked`` the same with an empty
    group before each group, which is set exactly when its group is. ``fields``
    are (name, group number) in group order; ``unset`` the named groups that a
    match may leave out together with all groups behind them.
    """

    source: str
    java: str
    marked: str
    fields: tuple[tuple[str, int], ...]
    groups: int
    unset: frozenset[int]

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.fields]


class _Group:
    def __init__(self, number: int | None, parent: _Group | None, negative: bool = False) -> None:
        self.number, self.parent = number, parent
        self.optional = negative

    def is_optional(self) -> bool:
        return self.optional or (self.parent is not None and self.parent.is_optional())


def _refuse(pattern: str, what: str) -> ConfigError:
    return ConfigError("REGEX_ERROR", f"{what} in pattern {pattern!r}")


def _bracket(pattern: str, at: int) -> tuple[str, int]:
    """The bracket class that starts at ``at``, for Java, and where it ends."""
    end = at + 1
    out = "["
    if pattern[end : end + 1] == "^":
        out, end = "[^", end + 1
    first = True
    while end < len(pattern):
        c = pattern[end]
        if c == "]" and not first:
            return out + "]", end + 1
        first = False
        named = re.compile(r"\[:(\^?)(\w+):\]").match(pattern, end)
        if named:
            if named[2] not in POSIX_CLASSES:
                raise _refuse(pattern, f"unknown class {named[0]}")
            java = POSIX_CLASSES[named[2]]
            out += f"[^{java}]" if named[1] else java
            end = named.end()
        elif c == "\\":
            escape = _PLAIN_ESCAPE.match(pattern, end)
            if not escape:
                break
            out += r"\x08" if escape[0] == r"\b" else escape[0]
            end = escape.end()
        else:
            # Java nests classes and intersects them with &&; here both are plain text.
            out += "\\" + c if c in "[]&" else c
            end += 1
    raise _refuse(pattern, "open bracket class")


def translate(pattern: str) -> FieldPattern:
    """Rewrite a pattern and collect its named groups."""
    plain: list[str] = []
    marked: list[str] = []
    names: dict[str, int] = {}
    root = _Group(None, None)
    here, groups, count, at = root, [root], 0, 0
    by_number: dict[int, _Group] = {}

    def both(text: str) -> None:
        plain.append(text)
        marked.append(text)

    def open_group(number: int | None, text: str, negative: bool = False) -> None:
        nonlocal here
        here = _Group(number, here, negative)
        groups.append(here)
        if number is None:
            both(text)
        else:
            by_number[number] = here
            plain.append("(")
            marked.append("(?:()(")

    def back(number: int) -> None:
        if not 1 <= number <= count:
            raise _refuse(pattern, f"reference to missing group {number}")
        plain.append(f"(?:\\{number})")
        marked.append(f"(?:\\{2 * number})")

    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith(r"\Q", at):
            stop = pattern.find(r"\E", at)
            literal = pattern[at + 2 : stop if stop >= 0 else len(pattern)]
            both(re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", literal))
            at = stop + 2 if stop >= 0 else len(pattern)
        elif named_back := _NAMED_BACK.match(pattern, at):
            name = next(g for g in named_back.groups() if g)
            if name not in names:
                raise _refuse(pattern, f"reference to missing group {name}")
            back(names[name])
            at = named_back.end()
        elif number_back := _NUMBER_BACK.match(pattern, at):
            number = int(next(g for g in number_back.groups() if g))
            if number_back[3] and number > max(count, 9):
                # Some engines read this as an octal character, others as a group to come.
                raise _refuse(pattern, f"reference or octal {number_back[0]}")
            back(number if number > 0 else count + 1 + number)
            at = number_back.end()
        elif c == "\\":
            escape = _PLAIN_ESCAPE.match(pattern, at)
            if not escape:
                raise _refuse(pattern, "backslash at the end")
            if escape[0][1] in "KNCg":
                raise _refuse(pattern, f"unsupported {escape[0]}")
            both({r"\b": WORD_EDGE, r"\B": NO_WORD_EDGE}.get(escape[0], escape[0]))
            at = escape.end()
        elif c == "[":
            text, at = _bracket(pattern, at)
            both(text)
        elif pattern.startswith("(?#", at):
            at = pattern.find(")", at) + 1 or len(pattern)
        elif opened := _NAMED_OPEN.match(pattern, at):
            name = opened[1] or opened[2]
            if name in names:
                raise _refuse(pattern, f"second group {name}")
            count += 1
            names[name] = count
            open_group(count, "(")
            at = opened.end()
        elif opened := _FLAGS_SET.match(pattern, at):
            both(opened[0])
            at = opened.end()
        elif opened := _FLAGS_OPEN.match(pattern, at):
            open_group(None, opened[0], negative=opened[0].endswith("!"))
            at = opened.end()
        elif pattern.startswith("(?", at) or pattern.startswith("(*", at):
            raise _refuse(pattern, f"unsupported {pattern[at : at + 3]}")
        elif c == "(":
            count += 1
            open_group(count, "(")
            at += 1
        elif c == ")":
            if here is root:
                raise _refuse(pattern, "unmatched )")
            at += 1
            if _ZERO_TIMES.match(pattern, at):
                here.optional = True
            plain.append(")")
            marked.append("))" if here.number is not None else ")")
            here = here.parent  # type: ignore[assignment]
        else:
            if c == "|":
                here.optional = True
            literal_brace = c == "{" and not _QUANTIFIER.match(pattern, at)
            both("\\{" if literal_brace else c)
            at += 1
    if here is not root:
        raise _refuse(pattern, "missing )")
    if not names:
        raise ConfigError("REGEX_ERROR", f"pattern {pattern!r} has no named group")

    last_certain = max((n for n, g in by_number.items() if not g.is_optional()), default=0)
    return FieldPattern(
        source=pattern,
        java="".join(plain),
        marked="".join(marked),
        fields=tuple(sorted(names.items(), key=lambda f: f[1])),
        groups=count,
        unset=frozenset(n for n in names.values() if n > last_certain),
    )


_compiled: set[str] = set()


def compile_pattern(spark: SparkSession, pattern: str) -> FieldPattern:
    """Translate a pattern and have Java compile it, before any data is read."""
    ready = translate(pattern)
    if pattern not in _compiled:
        tests = {"plain": f"(?d){ready.java}", "marked": f"(?d){ready.marked}"}
        try:
            spark.sql("SELECT '' RLIKE :plain, '' RLIKE :marked", args=tests).collect()
        except Exception as failure:
            raise ConfigError("REGEX_ERROR", f"invalid pattern {pattern!r}: {failure}") from failure
        _compiled.add(pattern)
    return ready


def _behind_group(java: str, at: int) -> int:
    """The place behind the group or bracket class that opens at ``at``."""
    depth, brackets = 0, 0
    while at < len(java):
        c = java[at]
        if c == "\\":
            at += 1
        elif c == "[":
            brackets += 1
        elif c == "]" and brackets:
            brackets -= 1
        elif not brackets and c in "()":
            depth += 1 if c == "(" else -1
        at += 1
        if not depth and not brackets:
            break
    return at


def required_literals(java: str) -> list[str]:
    """Texts that every match of a translated pattern holds; none where that is not plain to see.

    Only what stands outside all groups counts. A choice, or a flag, leaves nothing certain.
    """
    runs: list[str] = [""]
    at = 0
    while at < len(java):
        c = java[at]
        quantifier = _QUANTIFIER.match(java, at) if c == "{" else None
        if c == "|" or _FLAGS_SET.match(java, at) or _FLAGS_OPEN.match(java, at) and java[at + 2] not in ":=!<":
            return []
        if c in "*?+" or quantifier:
            if _ZERO_TIMES.match(java, at):
                runs[-1] = runs[-1][:-1]
            runs.append("")
            at = quantifier.end() if quantifier else at + 1
            # A lazy or possessive mark changes nothing here.
            at += java[at : at + 1] in ("?", "+")
        elif c in "([":
            runs.append("")
            at = _behind_group(java, at)
            # What a quantifier behind it drops is no literal.
            runs.append("")
        elif c == "\\":
            escape = _PLAIN_ESCAPE.match(java, at)
            text = escape[0] if escape else java[at:]
            if len(text) == 2 and not text[1].isalnum():
                runs[-1] += text[1]
            else:
                runs += ["", ""]
            at += len(text)
        elif c in ".^$":
            runs += ["", ""]
            at += 1
        else:
            runs[-1] += c
            at += 1
    return [run for run in runs if run]


def _telling(java: str) -> str | None:
    """The required text that lines are least likely to hold; none if any line may well hold all of them."""
    found = [run for run in required_literals(java) if len(run) > 1 or not (run.isalnum() or run.isspace())]
    return max(found, key=len, default=None)


def matches(line: Column, pattern: FieldPattern) -> Column:
    """Whether the pattern is found anywhere in the line.

    Lines without a text that every match holds are told by that, and their characters not matched.
    """
    found = line.rlike(f"(?d){pattern.java}")
    telling = _telling(pattern.java)
    return found if telling is None else line.contains(telling) & found


def group_texts(line: Column, pattern: FieldPattern) -> list[tuple[str, Column]]:
    """Name and text of each named group in the first match; ``''`` where it is not set."""
    java = f"(?d){pattern.java}"
    return [(name, F.regexp_extract(line, java, number)) for name, number in pattern.fields]


# Parts the texts of groups; a line that holds it is matched once per group instead.
_PART = "\x01"


def group_list(line: Column, pattern: FieldPattern) -> Column:
    """The texts of all named groups in the first match, in order, by one match; for lines that match."""
    each = [text for _, text in group_texts(line, pattern)]
    if len(each) == 1:
        return F.array(*each)
    # The line becomes the texts of its groups; the lazy beginning leaves the first match where it is.
    whole = rf"(?d)\A(?s:.*?)(?:{pattern.java})(?s:.*)\z"
    texts = F.regexp_replace(line, whole, _PART.join(f"${number}" for _, number in pattern.fields))
    return F.when(line.contains(_PART), F.array(*each)).otherwise(F.split(texts, _PART, -1))


def was_set(line: Column, pattern: FieldPattern, group: int) -> Column:
    """Whether the first match set this group or any behind it.

    The first match is held by an atomic group; then a reference to the empty
    mark of a group matches exactly if that group took part.
    """
    marks = "|".join(f"\\{2 * n - 1}(?:)" for n in range(group, pattern.groups + 1))
    return line.rlike(rf"(?d)\A(?>(?s:.*?)(?:{pattern.marked}))(?:{marks})")
