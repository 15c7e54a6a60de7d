"""Secret scan by assignment-aware lexing.

Plain patterns find the well-known shapes. Beyond them, the whole text is lexed for name-literal pairs in the syntaxes that
source and configuration files share: assignments with ``=``, ``:``, ``:=`` and ``=>``, with a type before or after the
name, keys and subscripts in quotes, keyword arguments, defaults of look-ups (``getenv("NAME", "x")``), elements and
attributes, ``#define`` and ``ENV``. A value may begin on the next line or in brackets, go on over lines by ``+`` or
adjacent literals, be a call whose arguments are literals, a raw, triple-quoted or template string, an indented block, a
here-document, or another name. Names are constants in any order: what a sensitive name takes from others is followed until
nothing new is reached. The score is the sensitivity of the name times the strength of the literal.

The scan is local to a text and runs where the text is read; nothing is shuffled. Positions are code points. Defined
results: a null or empty text has no spans, equal rows give equal rows, texts of any length are scanned whole, an empty
table gives no rows, extra columns do not take part.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from touchline.llm.common import table

Span = tuple[int, int, str]

# The plain patterns, their least lengths and their order among spans that begin together.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = {"assign": 0, "access": 1, "hex": 2, "lexed": 3}
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Sensitivity of the words of a name; a pair counts where both words are there.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "auth": 0.6, "signature": 0.5,
}
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 1.0, ("encryption", "key"): 1.0, ("signing", "key"): 1.0, ("client", "secret"): 1.0}
HARMLESS = {"count", "max", "min", "limit", "length", "len", "size", "type", "name", "url", "path", "file", "field", "prompt", "hint", "label", "expiry", "ttl", "id"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|undefined|change_?me|example.*|your[_-].*|todo|redacted|<.*>|\$\{.*\}|%\(.*\)s|\{\{.*\}\})$")
STEMS = ("pass", "pwd", "secret", "token", "key", "cred", "bearer", "auth", "signature")
THRESHOLD = 0.5
# literals kept of names already followed; more are followed again
KEPT_LITERALS = 1_000_000

NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME = r"[A-Za-z_$][\w$]*(?:(?:\.|->|::|-)[A-Za-z_$][\w$]*)*"
NAME = re.compile(_NAME)
# where a value follows a name
HEAD = re.compile(
    r"<(?P<tag>[A-Za-z_][\w.\-]*)(?:[ \t][^<>\n]*)?>(?=[^<>\s])"
    r"|<(?P<empty>[A-Za-z_][\w.\-]*)[ \t][^<>\n]*/>"
    rf"|(?:\#[ \t]*define|\bENV|\bsetenv)[ \t]+(?P<defined>{_NAME})[ \t]+"
    r"""|[(\[][ \t]*(?P<q>["'])(?P<argument>[\w.\-]+)(?P=q)\s*,\s*(?=[A-Za-z@$]{0,2}["'`])"""
    rf"""|(?<![\w$.\-])(?P<quote>["']?)(?P<name>{_NAME})(?P=quote)(?:\[["'](?P<item>[\w.\-]+)["']\])?"""
    r"""(?:[ \t]*:[ \t]*(?P<type>[A-Za-z_&*?\[][^"'`\n=;{}()#]{0,60}?)(?=[ \t]*=[^=>~])|[ \t]+(?P<word>[A-Za-z_][\w.\[\]<>*]{0,40})(?=[ \t]*=[^=>~]))?"""
    r"[ \t]*(?P<op>:=|=>|=(?![=>~])|:(?![:=]))"
)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>#]+""")
BLANK, SEPARATORS, LINE_END = re.compile(r"[ \t]*"), re.compile(r"[\s,]*"), re.compile(r"\\?\r?\n[ \t]*")
ELEMENT_TEXT = re.compile(r"[^<>\n]+(?=</)")
KEY_ATTRIBUTE = re.compile(r"""\b(?:key|name|id)[ \t]*=[ \t]*["']([\w.\-]+)""")
VALUE_ATTRIBUTE = re.compile(r"""\bvalue[ \t]*=[ \t]*(["'])([^"'\n]*)\1""")
BLOCK = re.compile(r"[ \t]*[|>][+\-\d]{0,2}[ \t]*(?:#[^\n]*)?\n")
HERE = re.compile(r"""(?:\$\([ \t]*cat[ \t]*)?<<[-~]?[ \t]*["']?([A-Za-z_]\w*)["']?[^\n]*\n""")
FIRST_WORD = re.compile(r"^[ \t]*([A-Za-z_]\w*)", re.M)
REFERENCE = re.compile(r"\$\{?([A-Za-z_]\w*)\}?")
CALL = re.compile(rf"(?:new[ \t]+)?{_NAME}!?\(")
OPENS = re.compile(r"""[rRbBuUfF@$]{0,2}(?P<hash>#*)(?P<open>\"\"\"|\'\'\'|["'`])""")
PLAIN = {q: re.compile(rf"(?:[^{q}\\\n]|\\[\s\S])*") for q in "\"'"}
GOES_ON = re.compile(r"""\s*\+\s*(?=["'`\w$@(])|[ \t]*\.[ \t]*(?=["'])|[ \t]*\\\r?\n[ \t]*(?=["'])|[ \t]+(?=["'])""")
KEY_FOLLOWS = re.compile(r"\s*(?::=|=>|=(?!=)|:(?!:))")

Part = tuple[int, int, str, bool]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind, as (start, end, kind)."""
    out = []
    lowered = text.lower()
    if any(h in lowered for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def name_weight(name: str) -> float:
    """Sensitivity of a name by its words, in snake, kebab, dotted or camel case."""
    words = [w.lower() for w in NAME_WORDS.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    have = set(words) | {w.removesuffix("s") for w in words}
    single = max((SENSITIVE.get(w, 0.0) for w in have), default=0.0)
    return max([single, *(s for (a, b), s in SENSITIVE_PAIRS.items() if a in have and b in have)])


def literal_strength(value: str) -> float:
    """0 to 1 by length, entropy and mixture of character classes; placeholders and phrases have none."""
    if len(value) < 6 or PLACEHOLDER.match(value) or " " in value.strip():
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    classes = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, len(value) / 12) * min(1.0, entropy / 3) * (0.6 + 0.1 * classes)


def string_at(text: str, at: int) -> "tuple[int, int, int] | None":
    """Begin and end of the body, and end, of the string literal that opens at a place, if one does."""
    m = OPENS.match(text, at)
    if not m:
        return None
    quote, begin = m["open"], m.end()
    if m["hash"]:
        end = text.find('"' + m["hash"], begin) if quote == '"' else -1
        return (begin, end, end + 1 + len(m["hash"])) if end >= 0 else None
    if len(quote) == 3 or quote == "`":
        end = text.find(quote, begin)
        return (begin, end, end + len(quote)) if end >= 0 else None
    end = PLAIN[quote].match(text, begin).end()
    return (begin, end, end + 1) if text[end : end + 1] == quote else None


def lines_of(text: str, begin: int, end: int) -> list[Part]:
    """The lines of a stretch, without white space around them, each a literal."""
    out = []
    for line in text[begin:end].split("\n"):
        body = line.strip()
        if body:
            at = begin + line.index(body)
            out.append((at, at + len(body), body, False))
        begin += len(line) + 1
    return out


def indented(text: str, at: int, more_than: int) -> int:
    """End of the lines from ``at`` on that are empty or indented by more than a number of characters."""
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if line.strip() and len(line) - len(line.lstrip()) <= more_than:
            return at
        at = end + 1
    return len(text)


def indent_at(text: str, at: int) -> int:
    line = text[text.rfind("\n", 0, at) + 1 : at + 1]
    return len(line) - len(line.lstrip(" \t-"))


def value_on_next_line(text: str, at: int, name_at: int) -> list[Part]:
    """A bare value on a line of its own, further in than its name."""
    line = BARE.match(text, at)
    inside = at - text.rfind("\n", 0, at) - 1 > indent_at(text, name_at)
    if line and inside and text[line.end() : line.end() + 1] in ("", "\n", "\r") and line[0][-1] != ":" and "=" not in line[0].rstrip("="):
        return [(line.start(), line.end(), line[0], False)]
    return []


def value_at(text: str, at: int, op: str, name_at: int, firsts: dict[str, list[int]]) -> list[Part]:
    """Parts (start, end, value, whether it is a name) of the value that begins at a place.

    ``firsts``, filled when a here-document asks for it, has the places of lines by their first word."""
    if op == ":" and (m := BLOCK.match(text, at)):
        return lines_of(text, m.end(), indented(text, m.end(), indent_at(text, name_at)))
    at = BLANK.match(text, at).end()
    if m := HERE.match(text, at):
        if not firsts:
            for line in FIRST_WORD.finditer(text):
                firsts.setdefault(line[1], []).append(line.start())
        ends = firsts.get(m[1], [])
        k = bisect_left(ends, m.end())
        return lines_of(text, m.end(), ends[k]) if k < len(ends) else []
    if m := LINE_END.match(text, at):
        at = m.end()
        if not string_at(text, at) and text[at : at + 1] != "(":
            return value_on_next_line(text, at, name_at)
    depth, parts = 0, []
    while at < len(text):
        if depth:
            at = SEPARATORS.match(text, at).end()
        if found := string_at(text, at):
            begin, end, after = found
            if depth and KEY_FOLLOWS.match(text, after):
                break
            parts += lines_of(text, begin, end) if "\n" in text[begin:end] else [(begin, end, text[begin:end], False)]
            at = after
        elif text[at : at + 1] == "(":
            at, depth = at + 1, depth + 1
            continue
        elif depth and text[at : at + 1] == ")":
            at, depth = at + 1, depth - 1
        elif m := CALL.match(text, at):
            at, depth = m.end(), depth + 1
            continue
        elif m := REFERENCE.match(text, at):
            # not alone: a reference is no literal itself
            parts += [(m.start(1), m.end(1), m[1], True), (at, at, "", False)]
            at = m.end()
        elif depth or parts:
            m = NAME.match(text, at)
            if not m and depth and (m := BARE.match(text, at)):
                at = m.end()  # a number or an operator between arguments
                continue
            if not m or (depth and KEY_FOLLOWS.match(text, m.end())):
                break
            parts.append((m.start(), m.end(), m[0], True))
            at = m.end()
        elif m := BARE.match(text, at):
            first = NAME.match(m[0])
            if first and m[0][first.end() : first.end() + 1] in ("", "+") and GOES_ON.match(text, at + first.end()):
                parts.append((at, at + first.end(), first[0], True))
                at += first.end()
            else:
                parts.append((m.start(), m.end(), m[0], bool(first and first.end() == len(m[0]))))
                at = m.end()
        else:
            break
        if m := GOES_ON.match(text, at):
            at = m.end()
        elif not depth:
            break
    return parts


def assignments(text: str) -> Iterator[tuple[list[str], list[Part]]]:
    """Names and value parts of every name-literal pair; the search goes on inside the value, so nested ones follow."""
    at, firsts = 0, {}
    while m := HEAD.search(text, at):
        at = m.end()
        if tag := m["tag"] or m["empty"]:
            key, value = KEY_ATTRIBUTE.search(m[0]), VALUE_ATTRIBUTE.search(text, m.start(), m.end())
            if m["tag"] and (body := ELEMENT_TEXT.match(text, at)):
                yield [tag, *([key[1]] if key else [])], [(body.start(), body.end(), body[0], False)]
            if key and value:
                yield [key[1]], [(value.start(2), value.end(2), value[2], False)]
            at = m.start() + 1 + len(tag)
        elif m["defined"]:
            yield [m["defined"]], value_at(text, at, " ", m.start(), firsts)
        elif m["argument"]:
            yield [m["argument"]], value_at(text, at, ",", m.start(), firsts)[:1]
        else:
            parts = value_at(text, at, m["op"], m.start(), firsts)
            if m["op"] == ":" and len(parts) == 1 and parts[0][3] and parts[0][2].isalpha():
                # after a colon, a word of letters alone is a type, prose or another name, but no literal
                parts.append((at, at, "", False))
            yield [m["item"] or m["name"], *([m["word"]] if m["word"] else [])], parts


Step = str | tuple[int, int, str]


def sums(given: dict[str, list[list[Part]]]) -> "Callable[[list[Part]], dict[tuple[int, int], str]]":
    """A function from the parts of a value to all its literals in order, constants followed, each name once.

    What a name reaches is kept while it is little, so that names used often are followed once."""
    steps: dict[str, list[Step]] = {}
    kept: dict[str, dict[tuple[int, int], str]] = {}

    def of(parts: list[Part]) -> Iterator[Step]:
        for start, end, value, is_name in parts:
            if is_name and value in given:
                yield value
            elif not is_name or len(parts) == 1:
                yield start, end, value

    def followed(name: str) -> list[Step]:
        if name not in steps:
            steps[name] = list(dict.fromkeys(step for parts in given[name] for step in of(parts)))
        return steps[name]

    def reached(name: str) -> dict[tuple[int, int], str]:
        if name not in kept:
            whole, seen, rest = {}, {name}, followed(name)[::-1]
            while rest:
                step = rest.pop()
                if isinstance(step, str):
                    if step not in seen:
                        seen.add(step)
                        rest += followed(step)[::-1]
                else:
                    whole[step[:2]] = step[2]
            if sum(map(len, kept.values())) > KEPT_LITERALS:
                kept.clear()
            kept[name] = whole
        return kept[name]

    def literals(parts: list[Part]) -> dict[tuple[int, int], str]:
        each = list(dict.fromkeys(of(parts)))
        if len(each) == 1 and isinstance(each[0], str):
            return reached(each[0])
        whole: dict[tuple[int, int], str] = {}
        for step in each:
            if isinstance(step, str):
                for place, value in reached(step).items():
                    whole.setdefault(place, value)
            else:
                whole.setdefault(step[:2], step[2])
        return whole

    return literals


def lexed_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name directly, through constants or in a sum.

    Sensitivity flows from names to the names they take from until nothing rises, and each literal is judged by its
    name's. A value of any number of parts, constants followed, is judged as one sum too.
    """
    lowered = text.lower()
    if not any(s in lowered for s in STEMS):
        return []
    found_pairs = list(assignments(text))
    given: dict[str, list[list[Part]]] = {}
    for names, parts in found_pairs:
        for name in names:
            given.setdefault(name, []).append(parts)
    own = {name: name_weight(name) for name in given}
    weights = dict(own)
    todo = [name for name, weight in weights.items() if weight]
    while todo:
        name = todo.pop()
        for parts in given[name]:
            for *_, value, is_name in parts:
                if is_name and weights.get(value, 9.0) < weights[name]:
                    weights[value] = weights[name]
                    todo.append(value)
    found, literals = set(), sums(given)
    judged: dict[str, float] = {}
    for names, parts in found_pairs:
        weight = max(weights[n] for n in names)
        if not weight:
            continue
        for start, end, value, is_name in parts:
            if (not is_name or (len(parts) == 1 and value not in given)) and weight * literal_strength(value) >= THRESHOLD:
                found.add((start, end))
        weight = max(own[n] for n in names)
        if not weight:
            continue
        # a value that is one name is judged once for all its uses
        alone = parts[0][2] if len(parts) == 1 and parts[0][3] and parts[0][2] in given else None
        if alone is not None and judged.get(alone, 0.0) >= weight:
            continue
        if alone is not None:
            judged[alone] = weight
        whole = literals(parts)
        if whole and weight * max([literal_strength("".join(whole.values())), *map(literal_strength, whole.values())]) >= THRESHOLD:
            found.update(whole)
    return [(s, e, "lexed") for s, e in sorted(found) if e > s]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS[x[2]], x[1])))


def find_secrets(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key and all spans of every text as an array of (kind, start, end), base kinds first."""
    kind = docs.schema[key].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(1):
                text = value.as_py() or ""
                spans = base_spans(text) + lexed_spans(text)
                found.append([{"kind": k, "start": s, "end": e} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], names=[key, "found"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, found array<struct<kind:string,start:int,end:int>>")


def span_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    kind = found.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[(x["start"], x["end"], x["kind"]) for x in r.as_py() or []] for r in batch.column(1)]
            base = [[s for s in r if s[2] != "lexed"] for r in rows]
            counts = [pa.array([sum(s[2] == k for s in r) for r in base], pa.int64()) for k in ("assign", "access", "hex")]
            digest = pa.array([hashlib.sha256(joined(r).encode()).hexdigest() for r in base], pa.string())
            spans = pa.array([joined(r) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, spans], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.mapInArrow(run, f"{key} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return span_digest(find_secrets(table(spark, sf_dir, "documents")))
