"""Deeply nested records as related flat tables.

A depth-first walk gives every node a pre-order and a post-order number. A node
lies inside another exactly if its interval does, so tables of one kind of node
are linked by interval containment instead of by paths, whatever nesting or
encoding a record came in.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from touchline.session import ship


#: Payloads whose nodes are held at once.
SLICE = 256


def _reject(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _read_deep(text: str) -> object:
    """The value of a JSON text of any depth; objects and lists that are still open
    stand in a list instead of on the stack of calls."""
    flat, space = json.JSONDecoder(parse_constant=_reject), json.decoder.WHITESPACE
    skip = lambda i: space.match(text, i).end()
    top: list = []
    open_: list = [top]
    keys: list[str] = []
    at, ready = skip(0), True
    while True:
        here = open_[-1]
        ch = text[at : at + 1]
        if ready and isinstance(here, dict):
            if ch != '"':
                raise ValueError("a key was expected")
            key, at = json.decoder.scanstring(text, at + 1)
            at = skip(at)
            if text[at : at + 1] != ":":
                raise ValueError("a colon was expected")
            keys.append(key)
            at = skip(at + 1)
            ch = text[at : at + 1]
        if ready:
            if ch in ("{", "["):
                value: object = {} if ch == "{" else []
                at = skip(at + 1)
                closed = text[at : at + 1] == ("}" if ch == "{" else "]")
                at = at + 1 if closed else at
            else:
                # neither an object nor a list: one step
                value, at = flat.raw_decode(text, at)
                closed = True
            if isinstance(here, dict):
                here[keys.pop()] = value
            else:
                here.append(value)
            if not closed:
                open_.append(value)
                continue
        at, ready = skip(at), False
        here = open_[-1]
        if here is top:
            if at != len(text):
                raise ValueError("text behind the value")
            return top[0]
        ch = text[at : at + 1]
        if ch == ",":
            at, ready = skip(at + 1), True
        elif ch == ("}" if isinstance(here, dict) else "]"):
            open_.pop()
            at += 1
        else:
            raise ValueError("a comma or an end was expected")


def parse(text: str | None) -> object | None:
    """The value of a JSON text; JSON held in a JSON string is unwrapped, however
    often it was wrapped, and depth is no limit.

    None for null, invalid and empty text and for ``null`` itself.
    """
    while text is not None:
        try:
            value = json.loads(text, parse_constant=_reject)
        except RecursionError:
            try:
                value = _read_deep(text)
            except ValueError:
                return None
        except ValueError:
            return None
        if not isinstance(value, str):
            return value
        # each wrapping has its own quotes, so the text gets shorter
        text = value
    return None


def _unwrap(value: object) -> object:
    """A record that came as JSON text becomes the record; other text stays."""
    if isinstance(value, str) and value[:1] in "{[ \t\r\n\"" and value.strip()[:1] in ("{", "["):
        held = parse(value)
        return value if held is None else held
    return value


def _plain(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def label(root: object, kinds: Mapping[str, str]) -> list[tuple[int, int, int, str, str | None, dict[str, str | None]]]:
    """``(pre, post, depth, kind, text, fields)`` of every node of a known kind.

    ``kinds`` names the kind of what stands under a key: the value, or each
    element if it is a list. Numbers count all nodes, so intervals nest as the
    record does. Scalars directly inside an object are its ``fields``; a scalar
    node has its value in ``text``. The walk keeps its own stack, so depth is
    no limit.
    """
    out: list = []
    pre = post = 0
    stack: list = [(root, None, 0, False, -1)]
    opened: list = []
    while stack:
        value, kind, depth, leaving, slot = stack.pop()
        if leaving:
            if slot >= 0:
                out[slot][1] = post
            post += 1
            continue
        value = _unwrap(value) if not isinstance(value, (dict, list)) else value
        slot = -1
        if kind is not None and not isinstance(value, list):
            fields = {k: _plain(v) for k, v in value.items() if not isinstance(v, (dict, list))} if isinstance(value, dict) else {}
            slot = len(out)
            out.append([pre, 0, depth, kind, None if isinstance(value, dict) else _plain(value), fields])
        pre += 1
        stack.append((None, None, depth, True, slot))
        if isinstance(value, list):
            stack.extend((v, kind, depth + 1, False, -1) for v in reversed(value))
        elif isinstance(value, dict):
            for k, v in reversed(value.items()):
                named = kinds.get(k)
                if named is not None or isinstance(v, (dict, list)) or isinstance(_unwrap(v), (dict, list)):
                    stack.append((v, named, depth + 1, False, -1))
    return [tuple(x) for x in out]


def label_nodes(df: DataFrame, keys: Sequence[str], payload: str, kinds: Mapping[str, str]) -> DataFrame:
    """``keys, doc, pre, post, depth, kind, text, fields map``: all labelled nodes.

    ``doc`` tells the payloads of one key apart by content, so a repeated row
    gives repeated nodes, which :func:`nodes_of` drops. Null, empty and invalid
    payloads have no nodes. Other columns are ignored.
    """
    ship(df.sparkSession)
    base = df.select(*keys, F.concat_ws(":", F.xxhash64(payload), F.length(payload)).alias("doc"), F.col(payload).alias("_payload"))
    head = [T.StructField(c, base.schema[c].dataType) for c in keys]
    schema = T.StructType([
        *head,
        T.StructField("doc", T.StringType()),
        T.StructField("pre", T.IntegerType()),
        T.StructField("post", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ])
    wanted = dict(kinds)
    n = len(keys) + 1
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # small slices: the nodes of a payload take more room than its text
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                take: list[int] = []
                columns: list[list] = [[] for _ in types]
                for row, text in enumerate(batch.column(n).to_pylist()):
                    root = parse(text)
                    if root is None:
                        continue
                    for node in label(root, wanted):
                        take.append(row)
                        for column, value in zip(columns, node):
                            column.append(list(value.items()) if isinstance(value, dict) else value)
                at = pa.array(take, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).take(at) for i in range(n)] + [pa.array(c, t) for c, t in zip(columns, types)], [f.name for f in schema]
                )

    return base.mapInArrow(run, schema)


def nodes_of(nodes: DataFrame, keys: Sequence[str], kind: str, fields: Mapping[str, str], records: bool = True) -> DataFrame:
    """The flat table of one kind; ``fields`` maps its columns to record fields.

    With ``records``, a null or a scalar where a record should be is no node.

    Distinct: copies of a record meet here as a few flat columns, combined on
    the map side first, so a hot group of copies costs nothing.
    """
    wanted = F.col("kind") == kind
    return (
        nodes.where(wanted & (F.size("fields") > 0) if records else wanted)
        .select(*keys, "doc", "pre", "post", "text", *[F.col("fields")[f].alias(c) for c, f in fields.items()])
        .distinct()
    )


def inside(children: DataFrame, parents: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Children with the columns of the parent whose interval holds theirs.

    The join is on the record, so both sides meet per record; parents of one
    kind must not nest, as events and markets don't. ``pre`` of the parent comes
    as ``parent_pre``, and the parent's ``text`` is dropped.
    """
    on = [*keys, "doc"]
    renamed = parents.drop("text").withColumnRenamed("pre", "parent_pre").withColumnRenamed("post", "parent_post")
    clash = (set(renamed.columns) & set(children.columns)) - set(on)
    if clash:
        raise ValueError(f"parent columns clash with child columns: {sorted(clash)}")
    c, p = children.alias("c"), renamed.alias("p")
    cond = F.lit(True)
    for name in on:
        cond = cond & F.col(f"c.{name}").eqNullSafe(F.col(f"p.{name}"))
    cond = cond & (F.col("p.parent_pre") < F.col("c.pre")) & (F.col("p.parent_post") > F.col("c.post"))
    own = [F.col(f"c.{x}") for x in children.columns]
    theirs = [F.col(f"p.{x}") for x in renamed.columns if x not in on and x != "parent_post"]
    return c.join(p, cond, how).select(*own, *theirs)
