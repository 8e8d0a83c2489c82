"""The lexer of exports: what a line does to the state it begins in, and the parts of a statement.

Between two lines an export is in one of five states: outside, inside a value in single or double
quotes, inside a name in backquotes, or inside a comment. A line is a function from state to state
with the number of statements it ends. Such functions are composed, so the blocks of a file can be
read apart: `summary` composes the lines of a block for every state it may begin in.

Patterns are possessive: a value of any size is matched in one step."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from webtrail import fixed_values as fixed

OUTSIDE, SINGLE, DOUBLE, NAME, COMMENT = range(5)
STATES = 5
_SINGLE = r"(?:[^'\\]++|\\.|'')*+"
_DOUBLE = r'(?:[^"\\]++|\\.|"")*+'
_NAME = r"(?:[^`]++|``)*+"
_REMARK = r"(?:[^*]++|\*(?!/))*+"
#: A quote that finds no end runs over the line. `#__` begins a name of a shipped schema. The text of
#: an executable comment is executed, so only its marks are left out.
TOKEN = re.compile(
    rf"""(?P<text>[^'"`;(),\#/*\-]++)|(?P<value>'{_SINGLE}'|"{_DOUBLE}")|(?P<name>`{_NAME}`)|(?P<open>['"`].*+)"""
    rf"""|(?P<note>--(?=[\x00-\x20]|\Z)[^\n]*+|\#(?!__)[^\n]*+)|(?P<remark>/\*(?!!){_REMARK}\*/)|(?P<hint>/\*![0-9]*+|\*/)"""
    r"""|(?P<unending>/\*.*+)|(?P<mark>[;(),])|(?P<other>[\#/*\-])""", re.S)
_END = {SINGLE: re.compile(_SINGLE + "'", re.S), DOUBLE: re.compile(_DOUBLE + '"', re.S), NAME: re.compile(_NAME + "`", re.S), COMMENT: re.compile(_REMARK + r"\*/", re.S)}
_OPENS = {"'": SINGLE, '"': DOUBLE, "`": NAME}
_SPECIAL = re.compile(r"['\"`;#*\-/]")
_NOTES = re.compile(r"--|#|/\*|\*/")


def line_ends(state: int, line: str) -> tuple[int, list[int]]:
    """The state after a line and where in it statements end."""
    at = 0
    if state != OUTSIDE:
        closed = _END[state].match(line)
        if not closed:
            return state, []
        at = closed.end()
    if not _SPECIAL.search(line, at):
        return OUTSIDE, []
    ends = []
    for token in TOKEN.finditer(line, at):
        kind = token.lastgroup
        if kind == "mark":
            if line[token.start()] == ";":
                ends.append(token.end())
        elif kind == "open":
            return _OPENS[line[token.start()]], ends
        elif kind == "unending":
            return COMMENT, ends
    return OUTSIDE, ends


def summary(lines: Iterable[str], so_far: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """For each state at the beginning: the state at the end and the statements ended. States that
    have met stay together, so most lines are read once or twice."""
    now = so_far or [(s, 0) for s in range(STATES)]
    for line in lines:
        step = {state: line_ends(state, line) for state in {s for s, _ in now}}
        now = [(step[s][0], n + len(step[s][1])) for s, n in now]
    return now


def pieces(lines: Iterable[str], state: int, number: int) -> Iterator[tuple[int, str, bool]]:
    """(statement, text, whether it ends there) of a block that begins in a state, within the statement
    of a number. Lines are joined by line breaks; what is cut by a `;` in the middle of a line is not."""
    held: list[str] = []
    for line in lines:
        state, ends = line_ends(state, line)
        at = 0
        for end in ends:
            held.append(line[at:end])
            yield number, "\n".join(held), True
            held, at, number = [], end, number + 1
        held.append(line[at:])
        # A block without an end is handed on in parts of a bounded size.
        if len(held) >= 4096 or len(line) > 1 << 20:
            yield number, "\n".join(held), False
            held = []
    if held:
        yield number, "\n".join(held), False


def without_notes(statement: str) -> str:
    """The statement with a space for each comment and each mark of an executable one."""
    if not _NOTES.search(statement):
        return statement
    left = ("note", "remark", "hint", "unending")
    return "".join(" " if t.lastgroup in left else t.group() for t in TOKEN.finditer(statement))


_ESCAPED = {"'": re.compile(r"\\(.)|''", re.S), '"': re.compile(r'\\(.)|""', re.S)}
#: What a letter after a backslash stands for.
_LETTERS = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "b": "\b", "Z": "\x1a"}


def literal(token: str) -> str | None:
    """A value of a row: NULL, a number or call as it stands, or a string in either quotes with its
    escapes read from left to right."""
    text = token.strip()
    if not text or text.upper() == "NULL":
        return None
    quote = text[0]
    if quote not in _ESCAPED or len(text) < 2 or text[-1] != quote:
        return text
    inner = text[1:-1]
    if "\\" not in inner and quote not in inner:
        return inner
    return _ESCAPED[quote].sub(lambda m: _LETTERS.get(m[1], m[1]) if m[1] else quote, inner)


def groups(text: str, at: int = 0) -> Iterator[list[str]]:
    """Contents of the brackets that stand side by side from a place on, cut at their own commas:
    the rows of a VALUES list. Brackets inside, to any depth, belong to their value. Anything but a
    comma between two brackets ends the list; a bracket without end gives nothing."""
    depth, begin, fields = 0, 0, []
    for token in TOKEN.finditer(text, at):
        kind = token.lastgroup
        if kind != "mark":
            if not depth and kind not in ("note", "remark", "hint") and token.group().strip():
                return
            continue
        mark = text[token.start()]
        if mark == "(":
            depth += 1
            if depth == 1:
                begin, fields = token.end(), []
        elif mark == ";":
            return
        elif depth and (mark == ")" or depth == 1):
            if depth == 1:
                fields.append(text[begin:token.start()])
                begin = token.end()
            if mark == ")":
                depth -= 1
                if not depth:
                    yield fields


_INSERT, _CREATE, _COLUMN = (re.compile(p) for p in (fixed.INSERT_HEAD, fixed.CREATE_HEAD, fixed.CREATED_COLUMN))


def insert(statement: str) -> tuple[str, list[str], Iterator[list[str | None]]] | None:
    """Table, listed columns and rows of an INSERT."""
    text = without_notes(statement)
    head = _INSERT.match(text)
    if not head:
        return None
    columns = [c.strip().strip("`").strip() for c in (head[2] or "").split(",")]
    return head[1], [c for c in columns if c], ([literal(f) for f in fields] for fields in groups(text, head.end()))


def created(statement: str) -> tuple[str, list[str]] | None:
    """Table and column names of a CREATE TABLE; keys and constraints, which do not begin with a quoted
    name, are no columns."""
    text = without_notes(statement)
    head = _CREATE.match(text)
    if not head:
        return None
    # The body's bracket is the last character of the head.
    fields = next(groups(text, head.end() - 1), None)
    if fields is None:
        return None
    names = map(_COLUMN.match, fields)
    return head[1], [n[1] for n in names if n]
