"""Rule catalogues: files of rules as people write them, checked and compiled to rows that joins take.

The files are the plain part of YAML: mappings and lists by indentation, {..} and [..] on one line, quoted and bare scalars,
comments. Scalars stay text (NO is a country, not a truth value); what isn't understood fails with its line.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')|([{}\[\],])|(:)(?=\s|$)|([^\s{}\[\],"':](?:[^{}\[\],:]|:(?!\s|$))*))""")
_ENTRY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'{\[#-](?:[^:#]|:(?!\s|$)|(?<!\s)#)*?)\s*:(?:\s+(.*))?$""")


class RuleError(ValueError):
    """A catalogue that can't be read, or that lacks what its form asks for."""


def _scalar(text: str) -> str:
    text = text.strip()
    if text[:1] == '"':
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    return text[1:-1].replace("''", "'") if text[:1] == "'" else text


def _bare(line: str) -> str:
    """The line without its comment; a # inside quotes, or inside a word, is none."""
    quote, skip = "", False
    for i, c in enumerate(line):
        if skip:
            skip = False
        elif quote:
            skip = line[i : i + 2] == "''" if quote == "'" else c == "\\"
            quote = "" if c == quote and not skip else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " \t:{[,-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


def _flow(text: str, where: str) -> object:
    """A value on one line: a scalar, a {..} or a [..]."""
    if text[:1] not in "{[":
        if text[:1] in "\"'" and (len(text) < 2 or text[-1] != text[0]):
            raise RuleError(f"{where}: no closing quote in {text!r}")
        return _scalar(text)
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise RuleError(f"{where}: can't read {text[at:]!r}")
        tokens.append((m.lastindex, m[m.lastindex]))
        at = m.end()

    def take() -> object:
        kind, token = tokens.pop(0) if tokens else (0, "")
        if token == "{" and kind == 2:
            out: dict[str, object] = {}
            while tokens and tokens[0] != (2, "}"):
                key = take()
                if not isinstance(key, str) or not tokens or tokens.pop(0)[0] != 3:
                    raise RuleError(f"{where}: a key without a value in {text!r}")
                out[key] = take()
                if tokens and tokens[0] == (2, ","):
                    tokens.pop(0)
            if not tokens:
                raise RuleError(f"{where}: no closing brace in {text!r}")
            tokens.pop(0)
            return out
        if token == "[" and kind == 2:
            rows: list[object] = []
            while tokens and tokens[0] != (2, "]"):
                rows.append(take())
                if tokens and tokens[0] == (2, ","):
                    tokens.pop(0)
            if not tokens:
                raise RuleError(f"{where}: no closing bracket in {text!r}")
            tokens.pop(0)
            return rows
        if kind not in (1, 4):
            raise RuleError(f"{where}: can't read {text!r}")
        return _scalar(token)

    value = take()
    if tokens:
        raise RuleError(f"{where}: more than one value in {text!r}")
    return value


def parse_rules(text: str, name: str = "rules") -> dict:
    """The mapping that a catalogue holds. A key that comes twice in one mapping fails."""
    lines = [(n, len(line) - len(line.lstrip(" ")), line.lstrip(" ")) for n, raw in enumerate(text.splitlines(), 1) if (line := _bare(raw)).strip()]
    for n, _, line in lines:
        if line.startswith("\t"):
            raise RuleError(f"{name}:{n}: indented by a tab")

    def block(at: int, depth: int) -> tuple[object, int]:
        out: object = [] if lines[at][2].startswith("- ") or lines[at][2] == "-" else {}
        while at < len(lines) and lines[at][1] == depth:
            n, _, line = lines[at]
            where = f"{name}:{n}"
            if isinstance(out, list):
                if not line.startswith("-"):
                    return out, at  # a list as deep as its key
                rest = line[1:].strip()
                inner = depth + len(line) - len(line[1:].lstrip())
                if rest and _ENTRY.match(rest) and rest[0] not in "{[":
                    lines[at] = (n, inner, rest)
                    value, at = block(at, inner)
                elif rest:
                    value, at = _flow(rest, where), at + 1
                else:
                    value, at = below(at, depth)
                out.append(value)
                continue
            m = _ENTRY.match(line)
            if not m:
                raise RuleError(f"{where}: no key in {line!r}")
            key = _scalar(m[1])
            if key in out:
                raise RuleError(f"{where}: {key!r} comes twice")
            out[key], at = (_flow(m[2], where), at + 1) if m[2] else below(at, depth)
        if at < len(lines) and lines[at][1] > depth:
            raise RuleError(f"{name}:{lines[at][0]}: indented too far")
        return out, at

    def below(at: int, depth: int) -> tuple[object, int]:
        """What is indented under a line; a list may also stand as deep as its key. Nothing is null."""
        nxt = at + 1
        if nxt < len(lines) and (lines[nxt][1] > depth or (lines[nxt][1] == depth and lines[nxt][2].startswith("- ") and not lines[at][2].startswith("-"))):
            return block(nxt, lines[nxt][1])
        return None, nxt

    if not lines:
        return {}
    out, at = block(0, lines[0][1])
    if at < len(lines) or not isinstance(out, dict):
        raise RuleError(f"{name}:{lines[min(at, len(lines) - 1)][0]}: the file holds no single mapping")
    return out


def read_rules(spark: SparkSession, path: str) -> dict:
    """The catalogue at any path that Spark reads; catalogues are small, so the driver takes the text."""
    (row,) = spark.read.text(path, wholetext=True).collect()
    return parse_rules(row[0], path)


def packaged(name: str) -> dict:
    """A catalogue of this package, written for the tables at hand."""
    return parse_rules((Path(__file__).parents[1] / "plans" / "rules" / f"{name}.yaml").read_text(encoding="utf-8"), name)


def _specs(value: object, where: str) -> list[tuple[str, str, str]]:
    """(id, name, scope) of a list of regulators; each needs an id and a name."""
    if value is None:
        return []
    if not isinstance(value, list):
        raise RuleError(f"{where}: a list is asked for")
    out = []
    for spec in value:
        if not isinstance(spec, dict) or not spec.get("id") or not spec.get("name") or set(spec) - {"id", "name", "scope"}:
            raise RuleError(f"{where}: a regulator has an id, a name and perhaps a scope, not {spec!r}")
        out.append((spec["id"], spec["name"], spec.get("scope") or ""))
    return out


def compile_regulators(rules: dict, countries: dict) -> list[tuple[str, str | None, str, str, str]]:
    """Rows (level, key, id, name, scope). Levels: default (no key), sector, industry, country; members of the union have its regulators with their own. Ids have one name."""
    unknown = set(rules) - {"default", "sector", "industry"}
    if unknown:
        raise RuleError(f"unknown parts of the catalogue: {sorted(unknown)}")
    rows = [("default", None, *s) for s in _specs(rules.get("default"), "default")]
    for level in ("sector", "industry"):
        rows += [(level, key, *s) for key, specs in (rules.get(level) or {}).items() for s in _specs(specs, f"{level} {key}")]
    union = countries.get("union") or {}
    own = {c.upper(): _specs((body or {}).get("all"), c) for c, body in countries.items() if c != "union"}
    for member in union.get("members") or []:
        own.setdefault(member.upper(), [])
        own[member.upper()] += [s for s in _specs(union.get("all"), "union") if s[0] not in {o[0] for o in own[member.upper()]}]
    rows += [("country", country, *s) for country, specs in own.items() for s in specs]
    names: dict[str, str] = {}
    for *_, i, name, _ in rows:
        if names.setdefault(i, name) != name:
            raise RuleError(f"{i!r} has two names: {names[i]!r} and {name!r}")
    return list(dict.fromkeys(rows))


def compile_map(rules: dict) -> list[tuple[str, str]]:
    """Rows (key, value) of a flat mapping."""
    for k, v in rules.items():
        if not isinstance(v, str) or not v:
            raise RuleError(f"{k!r} stands for one value, not for {v!r}")
    return list(rules.items())


def rule_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "level string, key string, regulator string, name string, scope string")
