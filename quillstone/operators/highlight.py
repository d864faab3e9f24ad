"""Highlighting: of the few hits of a page on the driver, of rows of a DataFrame where they are."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillstone.functions import analysis as an
from quillstone.functions import text as tx
from quillstone.plans import dsl


def _words(text: str) -> list[tuple[int, int, str]]:
    """(start, end, search-side token) of every word of a text."""
    folded = text.lower().translate(str.maketrans(an.ONE_TO_ONE)) if len(text.lower()) == len(text) else text
    return [(m.start(), m.end(), folded[m.start() : m.end()]) for m in re.finditer(r"[^\W_]+", folded)]


def spans(q: dsl.Query, field: str, text: str) -> list[tuple[int, int]]:
    """Stretches of ``text`` that the clauses on ``field`` point at, in order and without overlaps."""
    words, found = _words(text), []

    def among(wanted) -> None:
        found.extend((a, b) for a, b, w in words if w in wanted)

    def walk(x) -> None:
        if isinstance(x, dsl.Bool):
            for c in (*x.must, *x.filter, *x.should, *x.must_not):
                walk(c)
        elif isinstance(x, dsl.MultiMatch):
            if field in x.fields:
                among(set(an.host_tokens(x.text, "search")))
        elif getattr(x, "field", None) == field:
            if isinstance(x, dsl.Match):
                among(set(an.host_tokens(x.text, "search")))
            elif isinstance(x, dsl.Term):
                among(set(an.host_tokens(str(x.value), "search")))
            elif isinstance(x, dsl.Terms):
                among({t for v in x.values for t in an.host_tokens(str(v), "search")})
            elif isinstance(x, dsl.Phrase):
                want = an.host_tokens(x.text, "search")
                for i in range(len(words) - len(want) + 1) if want else ():
                    if [w for _, _, w in words[i : i + len(want)]] == want:
                        found.append((words[i][0], words[i + len(want) - 1][1]))
            elif isinstance(x, dsl.Fuzzy):
                for t in an.host_tokens(x.text, "search"):
                    most = tx.fuzziness(x.edits, len(t))
                    found.extend((a, b) for a, b, w in words if tx.osa(t, w, most) <= most)
            elif isinstance(x, dsl.Prefix):
                start = "".join(an.host_tokens(x.text, "search")[:1])
                found.extend((a, b) for a, b, w in words if start and w.startswith(start))
            elif isinstance(x, dsl.Wildcard):
                pattern = re.compile(tx.wildcard_regex(x.text.lower()).replace("^(?s)", "(?s)^"))
                found.extend((a, b) for a, b, w in words if pattern.match(w))

    walk(q)
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(found)):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def render(text: str, found: list[tuple[int, int]], pre: str = "<em>", post: str = "</em>") -> str:
    out, at = [], 0
    for a, b in found:
        out += [text[at:a], pre, text[a:b], post]
        at = b
    return "".join(out) + text[at:]


def fragments(text: str, found: list[tuple[int, int]], size: int, number: int, pre: str = "<em>", post: str = "</em>") -> list[str]:
    """Up to ``number`` pieces of about ``size`` bytes, each centred on a cluster of spans and cut between characters."""
    raw = text.encode()
    place = [0]
    for c in text:
        place.append(place[-1] + len(c.encode()))
    clusters: list[list[tuple[int, int]]] = []
    for a, b in ((place[a], place[b]) for a, b in found):
        if clusters and (a <= max(e for _, e in clusters[-1]) or b - clusters[-1][0][0] <= size):
            clusters[-1].append((a, b))
        else:
            clusters.append([(a, b)])
    out = []
    for c in clusters[:number]:
        middle = (c[0][0] + max(e for _, e in c)) // 2
        start = max(0, middle - size // 2)
        end = min(start + size, len(raw))
        if end == len(raw):
            start = max(0, len(raw) - size)
        while start and raw[start] & 0xC0 == 0x80:
            start -= 1
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        inside = [(max(a, start), min(b, end)) for a, b in c if max(a, start) < min(b, end)]
        chars = lambda n: len(raw[start:n].decode())
        out.append(render(raw[start:end].decode(), [(chars(a), chars(b)) for a, b in inside], pre, post))
    return out


def highlight(q: dsl.Query, source: dict, request: dict) -> dict[str, list[str]]:
    tag = lambda k, default: (request.get(k) or [default])[0] if isinstance(request.get(k), list) else request.get(k, default)
    pre, post = tag("pre_tags", "<em>"), tag("post_tags", "</em>")
    out = {}
    for name, own in request.get("fields", {}).items():
        value = source.get(name)
        found = spans(q, name, value) if isinstance(value, str) else []
        if found:
            options = {**request, **(own or {})}
            if "fragment_size" in options or "number_of_fragments" in options:
                size, number = options.get("fragment_size", 100), options.get("number_of_fragments", 5)
                if not 0 < size <= 50_000 or not 0 <= number <= 1_000:
                    raise dsl.QueryError("bad fragment options")
                out[name] = fragments(value, found, size, number, pre, post) if number else [render(value, found, pre, post)]
            else:
                out[name] = [render(value, found, pre, post)]
    return out


def marked(docs: DataFrame, q: dsl.Query, request: dict, name: str) -> DataFrame:
    """``docs`` with a column of marks by field, as ``highlight`` gives them; null where nothing is marked."""
    have = [f for f in request.get("fields", {}) if f in docs.columns and docs.schema[f].dataType == T.StringType()]
    kind = pa.map_(pa.string(), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = {f: batch.column(f).to_pylist() for f in have}
            marks = [highlight(q, {f: v[i] for f, v in texts.items()}, request) or None for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m and list(m.items()) for m in marks], kind)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.MapType(T.StringType(), T.ArrayType(T.StringType())))]))
