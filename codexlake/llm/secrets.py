"""Secret scan: base patterns, and an assignment-aware lexer over source and configuration syntax.

The lexer turns a text into name-literal pairs, carries constants from name to name and through `+`, and scores each
literal by the sensitive words of the name it reaches and by its own look. What scores enough is a span of kind `lex`
at the literal, unless a base span already covers it.

Scale: one pass, no shuffle, state of one document at a time; texts without any name that scores are not lexed. Defined
cases: a null text is empty; a text of any length is read whole, in time
that grows with its length; a constant of over MOST_CARRIED characters is not carried to other
names; an empty text has no spans; repeated rows are judged each by itself; further columns pass through, whatever their names.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexlake.llm.common import fresh, texts_in

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "lex")
THRESHOLD = 1.0

_ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: Found in every text with a name that name_score gives anything, and in every text with a URL's user and password.
_SENSITIVE_TEXT = re.compile(r"(?ai)pass[._-]*word|passwd|passphrase|pwd|secret|token|credential|auth|bearer|(?:api|access|private|signing)[._-]*key|://[^\s/@:]*:[^\s/@]+@")
#: One of these is in whatever _SENSITIVE_TEXT finds; plain searches come first.
_PARTS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "key", "://")
#: What the scan stops at: comments, strings, elements, flags, names. Signs inside words start no comment and no string.
_ITEM = re.compile(
    r"""(?P<comment>(?<![^\s;{}(),])\#(?P<hash>[^\n]*)|(?<![:\w"'/])//(?P<slashes>[^\n]*)|/\*(?P<block>[\s\S]*?)(?:\*/|\Z)|<!--(?P<xml>[\s\S]*?)(?:-->|\Z))
    |(?P<string>(?:(?<!\w)[rRbBuUfF]{1,2})?(?:\"\"\"(?P<d3>[\s\S]*?)\"\"\"|(?:(?<!\w)|(?<=[rRbBuUfF]))\'\'\'(?P<s3>[\s\S]*?)\'\'\'|"(?P<d1>(?:[^"\\\n]|\\.)*)"|(?<![A-Za-z0-9])'(?P<s1>(?:[^'\\\n]|\\.)*)'|(?<!\w)[rRbBuUfF]{1,2}'(?P<p1>(?:[^'\\\n]|\\.)*)'|`(?P<b1>[^`]*)`))
    |<(?P<tag>[A-Za-z][\w.:-]*)(?:\s[^<>]*)?>(?P<body>[^<>\n]+)</(?P=tag)\s*>
    |(?<!\S)(?P<flag>--?[A-Za-z][\w-]*)(?P<gap>=|[ \t]+(?!-))
    |(?P<url>[A-Za-z][A-Za-z0-9+.-]{0,31}://[^\s:/@"'`]*:)(?P<pw>[^\s@/"'`<>{}$]+)@
    |(?P<scheme>\b[Bb]earer[ \t]+)(?P<bearer>[A-Za-z0-9._~+/-]{16,}=*)
    |(?P<name>\$?[A-Za-z_][\w]*(?:[.-]+[A-Za-z_0-9]\w*)*)""", re.VERBOSE,
)
_STRINGS = ("d3", "s3", "d1", "s1", "p1", "b1")
_OP = re.compile(r"""[ \t]*\]?[ \t]*(?:(?::[ \t]*[A-Za-z_][\w.]*(?:\[[\w., |\[\]]*\])?\??(?:[ \t]+=(?!=)|=(?=[\"'])))|=>|:=|\+=|=(?!=)|(?P<colon>:(?![:/=])))[ \t]*""")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t]*(?:#[^\n]*)?\n")
_REF = re.compile(r"\$\{(?P<braced>[A-Za-z_][\w.]*)(?::?[-=](?P<default>[^}\n]*))?\}|\$?(?P<ref>[A-Za-z_][\w.]*)(?=[ \t]*(?:[;,)\]}\r\n+#]|$)|[ \t]+//|[ \t]*/\*)")
_BARE = re.compile(r"""[^\s"'`;,(){}\[\]<>]+""")
_SCHEME = re.compile(r"(?:Bearer|Basic|Token|Digest)[ \t]+(?=\S)")
_SETTER = re.compile(r"(?:set|with|put|add)(?=[A-Z_])")
#: Between terms: blanks, comments and line ends around a plus; a next string after blanks, or after a line's end inside brackets.
_SPACE = r"(?:[ \t\r\n]|\\\n|\#[^\n]*\n|//[^\n]*\n|/\*[\s\S]{0,4096}?\*/)*"
_PLUS = re.compile(rf"{_SPACE}\+{_SPACE}")
_NEXT_STRING = re.compile(r"(?:[ \t]|\\\r?\n)*(?=[rRbBuUfF]{0,2}[\"'])")
_NEXT_STRING_INSIDE = re.compile(rf"{_SPACE}(?=[rRbBuUfF]{{0,2}}[\"'])")
_OPEN = re.compile(r"(?:[ \t]*\()*[ \t\r\n]*")
_LEAD = re.compile(r"[ \t-]*")
#: What names bring into one value is at most so many characters and literals; a constant beyond that stays with its own name.
MOST_CARRIED = 1 << 14
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: What a word of a name adds; two words that only count together.
_WORDS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.8, "secret": 0.8, "token": 0.7, "apikey": 0.9, "credential": 0.7, "credentials": 0.7, "auth": 0.5, "authorization": 0.8, "bearer": 0.8}
_PAIRS = {("api", "key"): 0.9, ("access", "key"): 0.8, ("private", "key"): 0.9, ("signing", "key"): 0.8, ("pass", "word"): 1.0}
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|example.*|your[_-].*|<.*>|\$\{.*\}|none|null|true|false|undefined|todo|placeholder|password|secret|test(?:ing)?)$")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def name_score(name: str) -> float:
    parts = [p.lower() for p in _NAME_PART.findall(name)]
    return max([0.0, *(_WORDS.get(p, 0.0) for p in parts), *(_PAIRS.get(p, 0.0) for p in zip(parts, parts[1:], strict=False))])


def literal_score(value: str) -> float:
    """0 for what is no secret; up to 1 by length, kinds of characters and entropy."""
    if len(value) < 8 or _PLACEHOLDER.match(value) or " " in value.strip():
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if kinds < 2:
        return 0.0
    return min(1.0, 0.2 * kinds + 0.1 * max(0.0, entropy - 2))


Place = tuple[int, int]
Pair = tuple[str, str, list[Place]]


class Lexer:
    """Name-literal pairs of a text in source or configuration syntax, with constants carried along.

    Read are: assignments (`=`, `:=`, `=>`, `+=`, `:`, with a type between or not), keys in quotes and in brackets,
    block scalars, literals in one, three or back quotes, sums and neighbours of literals over lines, references to
    names, `$names` and `${names:-with a default}`, elements, flags, setters, pairs of arguments, users' passwords in
    URLs and bearer values; comments and literals that hold assignments are read like texts of their own.
    """

    def __init__(self, text: str):
        self.text, self.known = text, {}
        self.line_ends = [m.start() for m in re.finditer("\n", text)]

    def pairs(self, at: int = 0, end: int | None = None, depth: int = 0) -> Iterator[Pair]:
        text, end = self.text, len(self.text) if end is None else end
        while m := _ITEM.search(text, at, end):
            kind, at = m.lastgroup, m.end()
            if m["comment"] is not None:
                if depth < 3:
                    yield from self.pairs(*next(m.span(g) for g in ("hash", "slashes", "block", "xml") if m[g] is not None), depth + 1)
            elif m["string"] is not None:
                inner = next(g for g in _STRINGS if m[g] is not None)
                if len(m[inner]) <= 128 and (op := _OP.match(text, at, end)):
                    at = yield from self._assigned(m[inner], op, end, depth)
                    continue
                if text[: m.start()].rstrip(" \t\r\n")[-1:] == "(" if m.start() < 256 else text[m.start() - 256 : m.start()].rstrip(" \t\r\n")[-1:] == "(":
                    comma = re.compile(r"[ \t]*,[ \t\r\n]*(?=[rRbBuUfF]{0,2}[\"'])").match(text, at, end)
                    if comma and name_score(m[inner]):  # put("name", "value")
                        value, places, at, whole = self._value(comma.end(), end, False)
                        if whole and places:
                            yield m[inner], value, places
                        continue
                if depth < 3 and re.search("[=:]", m[inner]):
                    yield from self.pairs(*m.span(inner), depth + 1)
            elif kind == "body":
                yield m["tag"], m["body"].strip(), [self._trimmed(*m.span("body"))]
            elif kind == "gap":
                yield from self._flag(m, end)
                at = m.end("flag") + 1
            elif kind == "pw":
                yield "password", m["pw"], [m.span("pw")]
            elif kind == "bearer":
                yield "bearer", m["bearer"], [m.span("bearer")]
            else:
                op = _OP.match(text, at, end)
                if op and (m["name"][-1] != "-"):
                    at = yield from self._assigned(m["name"], op, end, depth)
                elif text[at : at + 1] == "(" and _SETTER.match(m["name"].rsplit(".", 1)[-1]):
                    value, places, _, whole = self._value(at + 1, end, False)
                    if whole and places:
                        yield m["name"], value, places

    def _flag(self, m: re.Match, end: int) -> Iterator[Pair]:
        value, places, _, whole = self._value(m.end(), end, False, alone=True)
        if whole and places:
            yield m["flag"], value, places

    def _assigned(self, name: str, op: re.Match, end: int, depth: int) -> Iterator[Pair]:
        """The pair of an assignment; returns where it ends."""
        value, places, at, whole = self._value(op.end(), end, op["colon"] is not None, key=op.start())
        if whole and places:
            if not depth and len(value) + len(places) <= MOST_CARRIED:
                self.known[name.strip("${}")] = value, places
            yield name, value, places
        # what a literal holds may be assignments too
        for s, e in places if depth < 3 else ():
            if op.end() <= s and re.search("[=:]", self.text[s:e]):
                yield from self.pairs(s, e, depth + 1)
        return max(at, op.end())

    def _indent(self, at: int) -> int:
        """How many blanks and dashes stand before what the line of a place begins with."""
        k = bisect.bisect_left(self.line_ends, at)
        start = self.line_ends[k - 1] + 1 if k else 0
        return _LEAD.match(self.text, start, at).end() - start

    def _trimmed(self, s: int, e: int) -> Place:
        said = self.text[s:e]
        return s + len(said) - len(said.lstrip()), e - (len(said) - len(said.rstrip()))

    def _value(self, at: int, end: int, colon: bool, key: int = 0, alone: bool = False) -> tuple[str, list[Place], int, bool]:
        """(constant, places of its literals, end, whether all of it is constant) of an expression; key: where an assignment's sign begins."""
        text = self.text
        if colon and (m := _BLOCK.match(text, at, end)):
            return self._block(m.end(), end, self._indent(key))
        m = _OPEN.match(text, at, end) if text[at : at + 1] == "(" else None
        inside, at = bool(m), m.end() if m else at
        said, places, whole, carried = [], [], True, 0

        def add(value: str, more: list[Place], known: bool = False) -> None:
            nonlocal carried
            carried += known * (len(value) + len(more))
            if carried <= MOST_CARRIED:
                said.append(value)
                places.extend(more)

        while at < end:
            m = _ITEM.match(text, at, end)
            if m and m["string"] is not None:
                inner = next(g for g in _STRINGS if m[g] is not None)
                s, e = m.span(inner)
                scheme = _SCHEME.match(text, s, e)
                at = m.end()
                add(self._filled(m[inner][scheme.end() - s if scheme else 0 :]), [(scheme.end() if scheme else s, e)])
                near = (_NEXT_STRING_INSIDE if inside else _NEXT_STRING).match(text, at, end)
                if near and (near.end() > at or inside) and not alone:
                    at = near.end()
                    continue
            elif m := _REF.match(text, at, end):
                got, at = self.known.get(m["braced"] or m["ref"]), m.end()
                if got:
                    add(*got, True)
                elif m["default"]:
                    add(m["default"], [m.span("default")])
                elif m["ref"] and text[m.start()] != "$" and not places:
                    if text[at : at + 1] == "+" and not text[at + 1 : at + 2].strip("\"'` \t\r\n") == "":
                        m = _BARE.match(text, m.start(), end)  # with a plus in it
                        at = m.end()
                    said.clear()
                    add(m[0], [m.span()])  # a bare word of a configuration
                else:
                    whole = False
            elif m := _BARE.match(text, at, end):
                scheme = _SCHEME.match(text, at, end)
                if scheme:
                    at = scheme.end()
                    continue
                head = m[0].split("//", 1)[0]
                if head != m[0] and (got := self.known.get(head.lstrip("$"))):
                    add(*got, True)  # a name and a comment
                    at += len(head)
                elif (hash_ := m[0].find("#")) > 0 and (got := self.known.get(m[0][:hash_])):
                    add(*got, True)
                    at += hash_
                elif text[m.end() : m.end() + 1] in ("(", "["):
                    return "".join(said), places, m.end(), False  # a call: its arguments are read on their own
                else:
                    add(m[0], [m.span()])
                    at = m.end()
            else:
                return "".join(said), places, at, False
            if alone or not (p := _PLUS.match(text, at, end)):
                break
            at = p.end()
        return "".join(said), places, at, whole and carried <= MOST_CARRIED

    def _filled(self, said: str) -> str:
        """A literal with the known names in braces put in."""
        left = MOST_CARRIED

        def put(m: re.Match) -> str:
            nonlocal left
            got = self.known.get(m[1])
            left -= len(got[0]) if got else 0
            return got[0] if got and left >= 0 else m[0]

        return re.sub(r"\$?\{([A-Za-z_][\w.]*)\}", put, said) if "{" in said else said

    def _block(self, at: int, end: int, indent: int) -> tuple[str, list[Place], int, bool]:
        """A block scalar: the lines that stand further in than their key."""
        lines, places = [], []
        while at < end:
            stop = self.text.find("\n", at, end)
            stop = end if stop < 0 else stop
            said = self.text[at:stop]
            if said.strip():
                if len(said) - len(said.lstrip(" ")) <= indent:
                    break
                places.append(self._trimmed(at, stop))
                lines.append(said.strip())
            at = stop + 1
        return "".join(lines), places, min(at, end), True


def pairs(text: str) -> Iterator[Pair]:
    """(name, constant value, where its literals are) of each assignment in order; names are followed to their values."""
    return Lexer(text).pairs()


def spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    if not text:
        return []
    found = base_spans(text)
    low = text.lower()
    if any(p in low for p in _PARTS) and _SENSITIVE_TEXT.search(text):
        lexed = set()
        for name, value, places in pairs(text):
            score = name_score(name)
            if score and score + literal_score(value) >= threshold and literal_score(value):
                lexed.update(places)
        own = sorted((a, b) for _, a, b in found)
        starts, reach = [a for a, _ in own], [*itertools.accumulate((b for _, b in own), max)]
        # covered if any of those that begin no later reaches as far
        found += [("lex", s, e) for s, e in lexed if not ((k := bisect.bisect_right(starts, s)) and reach[k - 1] >= e)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(docs: DataFrame, *, text_col: str = "text", threshold: float = THRESHOLD, out_col: str = "secret_spans") -> DataFrame:
    """docs with a column of spans (kind, start, end) in code points, by start and kind."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    at, name = docs.columns.index(text_col), fresh(out_col, docs.columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in(batches, at):
            found = pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in spans(t, threshold)] for t in texts], kind)
            yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, name])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(span))]))


def _said(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row for each document. The text itself does not leave the scan."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in(batches, 1):
            found = pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in spans(t)] for t in texts], kind)
            yield pa.RecordBatch.from_arrays([part.column(0), found], names=["doc_id", "found"])

    found = docs.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint>>")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda x: x["kind"] != "lex")
    return found.select("doc_id", *map(count, BASE), F.sha2(_said(base).cast("binary"), 256).alias("base_sha256"), _said(F.col("found")).alias("spans"))
