"""Secret scans: three base patterns and an assignment-aware lexer.

Base spans (code points, end exclusive), leftmost and non-overlapping for each kind, failing matches dropped:
`assign` (a sensitive name, = or :, a value of 8 or more characters; the span is the whole match), `access`
(AKIA and capitals or digits, 16 or more characters) and `hex` (32 or more of 0-9a-f).

The lexer reads assignments of source code and configuration files, as pairs of a name and the terms of an expression.
Names: `name = x`, `name: x`, `"name": x`, `name := x`, `name => x`, `name: type = x`, `NAME=x`, `--name=x`,
`export`, `const` and the like before it, `map["name"] = x`, `<name>x</name>`; a name may be as long as it is. Terms:
quoted strings, triple-quoted ones over several lines, what stands around the inserts of formatted strings, numbers and
other bare values, names, and sums of these, which go on over lines in parentheses or after +; the lines of a YAML block
(`name: |`); a string on the line after the sign. A call, a subscript or an attribute of something is no literal. A bare
name is a literal in configuration syntax only (NAME=x without spaces and brackets, or `name: x` alone on its line), and
there only if the text assigns nothing to it; elsewhere it is a reference.

A text is one scope: a name stands for the literals of all its assignments, before or after its use, also by way of
other names; a name that leads back to itself adds nothing. The literals that reach a name are scored by how sensitive
the name is, and by their length, mixture of character kinds and entropy; kind `literal` holds the literals with a score
of 1 or more, alone or joined with those of the same expression, that no base span covers.

Edge cases: a null or empty text has no spans; placeholders (`changeme`, `${X}`, `<...>`, one character repeated)
score nothing; literals with spaces count in quotes only, and of one kind of characters only for a passphrase; equal
literals at several places are spans each; a literal, or the literals of an expression together, may be as long as they are; a very long text, line, run of assignments or row of references is read in time linear in it (expressions that each reach many others of weak literals are joined one by one); repeated rows are
scanned each; an empty table gives no rows; columns of the input named as an added one are replaced, others stay
whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.batches import Texts, add_columns

KINDS = ("assign", "access", "hex", "literal")
MASK = "[secret]"


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
#: Greedy runs of 32 or more are the runs of any length that pass the test of length.
HEX = re.compile("[0-9a-f]{32,}")

#: Weight of the parts of a name (split at case changes, digits, _ - . and spaces).
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "signingkey": 1.0, "bearer": 0.8,
    "auth": 0.7, "key": 0.5, "pass": 0.6, "salt": 0.5, "cookie": 0.5, "session": 0.4, "dsn": 0.5,
}
_JOINS = (("api", "key"), ("private", "key"), ("access", "key"), ("signing", "key"))
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|changeme|example|placeholder|your[_-].*|none|null|true|false|todo|\$\{.*\}|<.*>|%\(.*\)s)$")
#: Names for which words of letters alone make a secret.
_PHRASES = ("passphrase", "mnemonic", "seedphrase")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_LINE = re.compile(r"[^\r\n]+")
_PATH = r"[A-Za-z_$][\w$]*+(?:[.-][\w$]+)*+"
_TARGET = re.compile(
    rf"""(?<![\w$.-])(?:(?P<q>["'`])(?P<quoted>{_PATH})(?P=q)|(?P<name>{_PATH}))(?P<inner>(?:\[[^\[\]\r\n]*+\])*+)"""
    r"""(?P<before>[\x20\t]*+)(?::[\x20\t]*+(?P<type>[A-Za-z_][\w.]*+(?:\[[\w.,|\x20\[\]]*+\])?+)[\x20\t]*+=(?![=>~])"""
    r"""|(?P<sep>:=|=>|\+=|={1,3}(?![=>~])|:(?!//|[:=])))"""
)
_SUBSCRIPT = re.compile(r"""\[\s*["']([^"'\]]+)["']\s*\]$""")
_STRING = re.compile(
    r'''(?P<prefix>[A-Za-z]{0,2})(?:"""(?P<dd>(?:[^"\\]|\\.|"(?!""))*+)"""|'''
    r"""\'\'\'(?P<ss>(?:[^'\\]|\\.|'(?!''))*+)\'\'\'"""
    r"""|"(?P<d>(?:[^"\\\r\n]|\\.)*+)"|'(?P<s>(?:[^'\\\r\n]|\\.)*+)'|(?P<t>`)(?P<b>[^`]*+)`)""",
    re.S,
)
_REFERENCE = re.compile(r"[A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)*+")
_BARE = re.compile(r"""[^\s,;"'`()\[\]{}<>|&]+""")
_BLANK, _BLANK_LINES = re.compile(r"[\x20\t]*"), re.compile(r"(?:\s|\\(?=\r?\n))*")
_PLUS = re.compile(r"\+(?![+=])|\.\.(?!\.)")
_BLOCK = re.compile(r"[\x20\t]*[|>][+-]?\d?[\x20\t]*(?=\r?\n)")
_INDENTED = re.compile(r"\r?\n(?P<indent>[\x20\t]*)(?P<line>[^\r\n]*)")
_INSERT = re.compile(r"\$?\{([^{}]*)\}")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>([^<>]+)</\1\s*>")
_END_OF_VALUE = re.compile(r"""[\x20\t]*(?:$|[\r\n]|\x20\#|\x20//)""")


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    parts += [a + b for a, b in zip(parts, parts[1:], strict=False) if (a, b) in _JOINS]
    return max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)


def strength(literal: str, phrase: bool = False) -> float:
    """0 to 1 by length, kinds of characters and entropy. phrase: words of letters alone count as two kinds."""
    if len(literal := literal.strip()) < 8 or _PLACEHOLDER.match(literal):
        return 0.0
    n = len(literal)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    kinds = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum() and not c.isspace()))
    if any(c.isspace() for c in literal) and kinds == 1 and not phrase:
        return 0.0
    return min(1.0, entropy / 4) * (0.5 if kinds == 1 and not phrase else 1.0)


def is_phrase(name: str) -> bool:
    return any(p in name.lower().replace("_", "") for p in _PHRASES)


def score(name: str, literal: str) -> float:
    """1 or more marks a secret: a name such as `password` needs little strength, one such as `key` needs all."""
    weight = sensitivity(name)
    if not weight:
        return 0.0
    found = strength(literal, is_phrase(name))
    return weight + found - 0.45 if found else 0.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "=" in text or ":" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


Term = tuple[int, int, str | None, bool]


def _strings(m: re.Match) -> list[Term]:
    """Literals and references of a quoted string; around the inserts of a formatted one."""
    kind = next(k for k in ("dd", "ss", "d", "s", "b") if m[k] is not None)
    s, e = m.span(kind)
    if kind != "b" and "f" not in m["prefix"].lower():
        return [(s, e, None, True)]
    out, at = [], s
    for x in _INSERT.finditer(m.string, s, e):
        if kind == "b" and m.string[x.start()] != "$":
            continue
        if x.start() > at:
            out.append((at, x.start(), None, True))
        if _REFERENCE.fullmatch(name := x[1].strip()):
            out.append((*x.span(1), name, False))
        at = x.end()
    return [*out, (at, e, None, True)] if e > at or not out else out


def _block(text: str, at: int, line_start: int) -> tuple[list[Term], int]:
    """The lines of a YAML block that begins at the end of a line: those indented further than its key."""
    key_indent = len(_BLANK.match(text, line_start)[0])
    terms: list[Term] = []
    while m := _INDENTED.match(text, at):
        if (line := m["line"].rstrip()) and len(m["indent"]) <= key_indent:
            break
        if line:
            s = m.start("line")
            terms.append((s, s + len(line), None, False))
        at = m.end()
        if at >= len(text):
            break
    return terms, at


class _Bare:
    """Ends of bare values: what begins within one (`a=b=c`) ends where it does, and is not read again."""

    def __init__(self):
        self.start = self.end = 0

    def match(self, text: str, at: int) -> int:
        """The end of the bare value at a place, or -1."""
        if not self.start <= at < self.end:
            found = _BARE.match(text, at)
            if not found:
                return -1
            self.start, self.end = found.span()
        return self.end


def _value(text: str, at: int, line_start: int, m: re.Match, bare: _Bare, before: bool) -> tuple[list[Term], int]:
    """Terms of the expression after the sign of assignment m, and where it ends. before: whether its line has other text before m.

    A term is (start, end, name or None, whether in quotes); with a name and in quotes False it is a reference, and with
    start < 0 a literal in configuration syntax unless the name is assigned (then start is its complement).
    """
    sep, quoted_key = m["sep"], m["quoted"] is not None
    if sep == ":" and (block := _BLOCK.match(text, at)):
        return _block(text, block.end(), line_start)
    spaced = bool(m["before"]) or text[at : at + 1].isspace()
    begun = _BLANK.match(text, at).end()
    if begun < len(text) and text[begun] in "\r\n":  # a string on the next line
        following = _BLANK_LINES.match(text, begun).end()
        if not _STRING.match(text, following):
            return [], at
        begun = following
    at, depth, terms = begun, 0, []
    while True:
        while text[at : at + 1] == "(":
            depth, at = depth + 1, _BLANK_LINES.match(text, at + 1).end()
        if found := _STRING.match(text, at):
            terms += _strings(found)
            at = found.end()
        elif (end := bare.match(text, at)) >= 0:
            name = _REFERENCE.match(text, at)
            if name and text[name.end() : name.end() + 1] in ("(", "[", "{"):
                return terms, name.end()  # a call or a part of something
            plain = sep == "=" and not spaced and text[end : end + 1] not in (")", ",", "]", "}")
            listed = sep == ":" and not quoted_key and not before and _END_OF_VALUE.match(text, end)
            config = (plain or listed) and not depth and not terms
            if name and (name.end() == end or not config and text[name.end()] == "+"):
                end = name.end()
                terms.append((~at if config else at, end, name[0], False))
            else:
                terms.append((at, end, None, False))
            at = end
        else:
            return terms, at
        blank = _BLANK_LINES if depth else _BLANK
        after = blank.match(text, at).end()
        while depth and text[after : after + 1] == ")":
            depth -= 1
            at = after + 1
            blank = _BLANK_LINES if depth else _BLANK
            after = blank.match(text, at).end()
        if plus := _PLUS.match(text, after):
            at = _BLANK_LINES.match(text, plus.end()).end()
        elif terms and terms[-1][3] and _STRING.match(text, after) and (depth or after > at):
            at = after  # neighbouring strings are one
        else:
            return terms, at


def pairs(text: str):
    """(name, terms) of each assignment, in the order of the text but for elements, which come last."""
    done, bare = 0, _Bare()
    for line in _LINE.finditer(text):
        s, e = line.span()
        at = max(s, done)
        if at >= e or text.find("=", at, e) < 0 and text.find(":", at, e) < 0:
            continue
        begins = s + len(text[s : s + 4096]) - len(text[s : s + 4096].lstrip(" \t-"))
        if begins == s + 4096:
            begins = e - len(text[s:e].lstrip(" \t-"))
        while at < e and (m := _TARGET.search(text, at, e)):
            name = m["quoted"] or m["name"]
            if m["inner"] and (key := _SUBSCRIPT.search(m["inner"])):
                name = key[1]
            terms, end = _value(text, m.end(), s, m, bare, m.start() > begins)
            if terms:
                yield name, terms
            # what follows a bare value may be a name again (`a=b=c`, `x: y = "z"`)
            quoted = terms and terms[-1][3]
            at = max(m.end(), end if quoted or end > e or len(terms) > 1 else m.end())
        done = max(done, at)
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            inner = m[2].strip()
            if inner:
                s = text.index(inner, m.start(2))
                yield m[1], [(s, s + len(inner), None, True)]


def lexed_spans(text: str) -> list[tuple[int, int]]:
    assigned: dict[str, list[list[Term]]] = {}
    for name, terms in pairs(text):
        assigned.setdefault(name, []).append(terms)

    def told(term: Term) -> tuple[int, int] | None:
        """Where the term's own literal is, if it has one."""
        s, e, name, _ = term
        if name is None or s < 0 and name not in assigned:
            return (~s if s < 0 else s, e)
        return None

    # a name that has one assignment, to one other name, stands for the end of such steps
    steps = {n: x[0][0][2] for n, x in assigned.items() if len(x) == 1 and len(x[0]) == 1 and told(x[0][0]) is None}
    ends: dict[str, str | None] = {}
    for name in steps:
        way: list[str] = []
        on_way: set[str] = set()
        while name in steps and name not in ends and name not in on_way:
            way.append(name)
            on_way.add(name)
            name = steps[name]
        end = None if name in on_way else ends.get(name, name)
        ends.update(dict.fromkeys(way, end))

    def joined(name: str, terms: list[Term]) -> tuple[list[tuple[int, int]], set[str] | None]:
        """Literals that reach an expression of a name, also by way of others, in the order of each expression; and the other names, if all that they stand for is among them."""
        out, todo, seen, whole = {}, [iter(terms)], {name}, True
        while todo:
            term = next(todo[-1], None)
            if term is None:
                todo.pop()
            elif span := told(term):
                if span[1] > span[0] and span not in out:
                    out[span] = None
            elif (at := ends.get(term[2], term[2])) == name:
                whole = False  # what else the name stands for is not among them
            elif at in assigned and at not in seen:
                seen.add(at)
                todo.append(t for x in assigned[at] for t in x)
        return list(out), seen - {name} if whole else None

    sensitive = sorted(((w, n) for n in assigned if (w := sensitivity(n))), reverse=True)
    found: set[tuple[int, int]] = set()
    # alone: of the names that a literal reaches the most sensitive one decides, so each name is entered once, from that one
    for phrase in (False, True):
        entered: set[str] = set()
        for _, name in sensitive:
            if is_phrase(name) != phrase:
                continue
            waiting = [name]
            while waiting:
                at = waiting.pop()
                if at in entered:
                    continue
                entered.add(at)
                for terms in assigned[at]:
                    for term in terms:
                        if span := told(term):
                            if span[1] > span[0] and span not in found and score(name, text[span[0] : span[1]]) >= 1:
                                found.add(span)
                        elif term[2] in assigned:
                            waiting.append(term[2])
    # together: expressions of a name that are made of the same names and literals are one
    done: set[str] = set()  # names all of whose literals are found, also those that reach them by way of others
    for _, name in sensitive:
        every = True
        for terms in {tuple((told(t), None if told(t) else t[2]) for t in x): x for x in assigned[name]}.values():
            if all(span in found or span[1] <= span[0] if (span := told(t)) else (at := ends.get(t[2], t[2])) in done or at not in assigned for t in terms):
                continue
            reached, names = joined(name, terms)
            if reached and score(name, "".join(text[s:e] for s, e in reached)) >= 1:
                found.update(reached)
                done |= names or set()
                every = every and names is not None
            else:
                every = False
        if every:
            done.add(name)
    return sorted(found)


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans by start, then kind as listed."""
    spans = base_spans(text)
    if "=" in text or ":" in text or "</" in text:
        base = sorted(spans)
        starts, reach = [a for a, _, _ in base], [-1, *accumulate((b for _, b, _ in base), max)]  # how far those up to a start go
        spans += [(s, e, "literal") for s, e in lexed_spans(text) if reach[bisect_right(starts, s)] < e]
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with MASK for the values of assignments and for the other spans; what overlaps is masked once."""
    out, at = [], 0
    for s, e, kind in spans:
        if kind == "assign" and (m := ASSIGN.match(text, s, e)):
            s = m.start(2)
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], MASK]
        at = e
    return "".join([*out, text[at:]])


_SPANS = "secret_spans array<struct<start:int,end:int,kind:string>>"


def find_secrets(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with secret_spans of each whole text. keep: the columns of df to carry (all, if None)."""

    def factory(_):
        def process(texts: Texts) -> list:
            found = [scan(texts.text(i)) for i in range(len(texts))]
            return [[[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in found]]

        return process

    return add_columns(df, text_col, _SPANS, factory, keep)


def mask_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with MASK in place of the secrets in its text; a null text stays null."""
    names = df.columns
    at = names.index(text_col)
    hidden = df.toDF(*(f"k{i}" for i in range(len(names))))

    def factory(_):
        def process(texts: Texts) -> list:
            out = []
            for i in range(len(texts)):
                text = texts.text(i)
                out.append(masked(text, scan(text)) if texts.valid[i] else None)
            return [pa.array(out, pa.string())]

        return process

    found = add_columns(hidden, f"k{at}", "masked string", factory, [c for c in hidden.columns if c != f"k{at}"])
    return found.select(*("masked" if i == at else f"k{i}" for i in range(len(names)))).toDF(*names)


def digest(found: DataFrame) -> DataFrame:
    def count(kind: str):
        return F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long")

    def joined(spans):
        parts = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
        return F.array_join(parts, ",")

    base = F.filter("secret_spans", lambda x: x["kind"] != "literal")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
        count("literal").alias("n_literal"),
    )
