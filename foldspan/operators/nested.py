"""Flat, linked tables from deeply nested records, by Dewey labels.

Every node of a record gets an ordinal path, ``record.player.list.item`` and so on
to any depth.  Its owner is the label with the last step cut off (two steps for
an entry of a list, whose list is no row of its own), and nodes are grouped into
tables by their schema path.  Scalars stay with their node, so nothing of a record is
lost; null entries make no node but keep their place.

Typed records are walked by their schema with ``posexplode``, one branch per
schema path, so a table reads only its own columns.  Payloads of text, in which
every writer stores lists its own way (arrays, objects keyed by position, encoded
JSON, blank-separated tokens, a bare object), have no schema to walk; they are
labelled in one Arrow pass over the scan, before the latest delivery is chosen,
so that labels and not payloads are shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

#: nested fields in the order of their steps; unknown ones follow by name
STEPS = {
    "": ("dora_markers", "scores", "ura_dora_markers", "hand", "last_discard", "last_tsumo", "last_kakan", "ryukyoku_tenpai_players"),
    "players": ("discards", "melds", "hand"),
    "players.melds": ("consumed",),
}
#: fields that hold a list however it is stored, and what their entries may be wrapped in
LISTS = {"players": "player", "discards": "discard", "melds": "meld", "consumed": ""}
#: the list whose entries hang directly below the record, and the places it always has
SPINE, PLACES = "players", 4
NODE = "label string, schema_path string, hops int, fields map<string,string>"
_BODY = "rec_id bigint, loaded_at timestamp, tie bigint, body struct<seats:map<int,int>,nodes:array<struct<label:string,schema_path:string,hops:int,fields:map<string,string>>>>"


def latest(df: DataFrame, key: str, value: str, tie: Column) -> DataFrame:
    """The newest delivery of each record: ``key, value`` by ``loaded_at``.

    Aggregated map-side, so repeated deliveries of one record never meet in one
    task.  Null ``loaded_at`` counts as oldest.
    """
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct("loaded_at", tie.alias("tie"))).alias(value))


def parent(label: Column) -> Column:
    """The label with the last step cut off; null for a root."""
    return F.when(label.contains("."), F.regexp_replace(label, r"\.[^.]*$", ""))


def last_step(label: Column) -> Column:
    return F.substring_index(label, ".", -1).cast("int")


def step_of(path: str, names: Collection[str]) -> dict[str, int]:
    """Steps of the nested fields of a node."""
    known = STEPS.get(path, ())
    steps = {name: i for i, name in enumerate(known)}
    return steps | {name: len(known) + i for i, name in enumerate(sorted(set(names) - set(known)))}


def _opened(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def entries(v: object) -> list[tuple[int, object]]:
    """Places and entries of a stored list, however stored; null and missing lists have none."""
    if isinstance(v, str):
        inner = _opened(v)
        if isinstance(inner, (list, dict)):
            return entries(inner)
        return [] if v.strip() == "null" else list(enumerate(t for t in re.split(r"[\s,;|]+", v) if t))
    if isinstance(v, list):
        return list(enumerate(v))
    if isinstance(v, dict) and v:
        if all(re.fullmatch(r"\d{1,9}", k) for k in v):
            return [(int(k), x) for k, x in v.items()]
        return [(0, v)]
    return []


def unwrap(v: object, depth: int = 32) -> object:
    """The record inside ``{"data": ..}``, ``{"state": ..}`` and such wrappers, to any usual depth.

    A layer counts as wrapper where it holds one of them but no players; text
    that encodes JSON is opened too.
    """
    for _ in range(depth):
        if isinstance(v, str) and (inner := _opened(v)) is not None:
            v = inner
        elif isinstance(v, dict) and SPINE not in v and any(v.get(k) is not None for k in ("state", "data", "payload")):
            v = next(v[k] for k in ("state", "data", "payload") if v.get(k) is not None)
        else:
            break
    return v


def _text(v: object) -> str:
    return v if isinstance(v, str) else json.dumps(v)


def _plain(x: object) -> bool:
    """Scalars, and lists of scalars, which stand with their owner as text besides being rows."""
    return x is not None and not isinstance(x, dict) and not (isinstance(x, list) and any(isinstance(e, (dict, list)) for e in x))


class _Walker:
    """Labels of one payload's nodes, of the wanted schema paths."""

    def __init__(self, paths: Collection[str] | None, fields: bool):
        self.paths, self.fields = None if paths is None else set(paths), fields
        self.labels: list[str] = []
        self.where: list[str] = []
        self.hops: list[int] = []
        self.held: list[list[tuple[str, str]] | None] = []

    def _wanted(self, path: str) -> bool:
        return self.paths is None or any(p == path or p.startswith(path + ".") for p in self.paths)

    def node(self, label: str, path: str, hops: int, v: object, shift: int = 0) -> None:
        own = isinstance(v, dict)
        if self.paths is None or (path or "record") in self.paths:
            self.labels.append(label), self.where.append(path or "record"), self.hops.append(hops)
            if self.fields:
                scalars = [(k, _text(x)) for k, x in v.items() if _plain(x)] if own else [("value", _text(v))]
                self.held.append(scalars)
        if not own:
            return
        nested = [k for k, x in v.items() if k in LISTS or isinstance(x, (dict, list))]
        steps = step_of(path, nested) if nested else {}
        for name in nested:
            below = f"{path}.{name}" if path else name
            if not self._wanted(below):
                continue
            x = v[name]
            if name not in LISTS and isinstance(x, dict):
                self.node(f"{label}.{shift + steps[name]}", below, 1, x)
                continue
            inner = LISTS.get(name)
            spine = path == "" and name == SPINE
            base, hops = (label, 1) if spine else (f"{label}.{shift + steps[name]}", 2)
            plain = not self.fields and not any(p.startswith(below + ".") for p in self.paths or ())
            for place, e in entries(x):
                if e is None:
                    continue
                if plain and self.paths is not None:
                    self.labels.append(f"{base}.{place}"), self.where.append(below), self.hops.append(hops)
                    continue
                if inner and isinstance(e, dict) and isinstance(e.get(inner), dict):
                    e = {k: y for k, y in e.items() if k != inner} | e[inner]
                if spine and not isinstance(e := _opened(e) if isinstance(e, str) else e, dict):
                    continue
                self.node(f"{base}.{place}", below, hops, e)

    def record(self, rec_id: int, v: object) -> dict[int, int]:
        """Walks one payload; gives the seats that players state, by place."""
        players = entries(v[SPINE]) if isinstance(v, dict) and SPINE in v else []
        self.node(str(rec_id), "", 0, v if isinstance(v, dict) else {}, shift=max([PLACES, *(p + 1 for p, _ in players)]))
        seats = {}
        for place, p in players:
            stated = p.get("seat") if isinstance(p, dict) else None
            if isinstance(stated, str) and re.fullmatch(r"\s*\d\s*", stated):
                stated = int(stated)
            if isinstance(stated, (int, float)) and not isinstance(stated, bool) and stated in range(PLACES):
                seats[place] = int(stated)
        return seats


def _shred(paths: Collection[str] | None, fields: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walk, ends, kept, seats = _Walker(paths, fields), [0], [], []
            for row, (rec_id, payload) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())):
                v = _opened(payload)
                if not isinstance(v, (dict, str)):
                    continue
                seats.append(list(walk.record(rec_id, unwrap(v)).items()))
                kept.append(row)
                ends.append(len(walk.labels))
            held = pa.array(walk.held, pa.map_(pa.string(), pa.string())) if fields else pa.nulls(len(walk.labels), pa.map_(pa.string(), pa.string()))
            nodes = pa.StructArray.from_arrays([pa.array(walk.labels, pa.string()), pa.array(walk.where, pa.string()), pa.array(walk.hops, pa.int32()), held], names=[f.split()[0] for f in NODE.split(", ")])
            rows = pa.array(kept, pa.int64())
            body = pa.StructArray.from_arrays([pa.array(seats, pa.map_(pa.int32(), pa.int32())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes)], names=["seats", "nodes"])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(3)), body], names=["rec_id", "loaded_at", "tie", "body"])

    return run


def state_nodes(states: DataFrame, paths: Collection[str] | None = None, fields: bool = True) -> DataFrame:
    """Nodes of ``game_states``: ``rec, rec_id, label, schema_path, hops, fields, seats``.

    Of several deliveries only the latest readable one counts, of equally late
    ones either.  ``seats`` maps a place to the seat that its player states.
    Records without readable delivery have no nodes; null players and entries make
    no node but keep the places of those after them.  ``paths`` restricts the
    result to some schema paths, without ``fields`` scalars are left out.
    """
    at = F.col("loaded_at").cast("timestamp").alias("loaded_at")
    read = states.select(F.col("state_id").cast("bigint").alias("rec_id"), at, F.xxhash64("payload").alias("tie"), "payload").where("rec_id is not null and payload is not null")
    record = latest(read.mapInArrow(_shred(paths, fields), _BODY), "rec_id", "body", F.col("tie"))
    nodes = record.select("rec_id", F.col("body.seats").alias("seats"), F.explode("body.nodes").alias("n"))
    return nodes.select(F.lit("state").alias("rec"), "rec_id", "n.label", "n.schema_path", "n.hops", "n.fields", "seats")


def typed_nodes(record: DataFrame, paths: Collection[str] | None = None, fields: bool = True) -> DataFrame:
    """Nodes of typed records, column ``v`` of key ``rec_id``, by a walk over its schema.

    One branch per schema path; each is a chain of ``posexplode`` down to its list.
    """
    out: list[DataFrame] = []

    def node(df: DataFrame, kind: DataType, path: str, hops: int, shift: int = 0) -> None:
        """``df`` has ``rec_id, label, v``; one row per node."""
        if paths is None or (path or "record") in paths:
            if not fields:
                held = F.lit(None).cast("map<string,string>")
            elif isinstance(kind, StructType):
                plain = {f.name: f.dataType for f in kind.fields if not isinstance(f.dataType, StructType) and not (isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, (ArrayType, StructType)))}
                text = lambda n: F.to_json(F.col("v")[n]) if isinstance(plain[n], ArrayType) else F.col("v")[n].cast("string")
                pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), text(n).alias("x")) for n in plain]), lambda p: p["x"].isNotNull()) if plain else None
                held = F.map_from_entries(pairs) if plain else F.create_map().cast("map<string,string>")
            else:
                held = F.create_map(F.lit("value"), F.col("v").cast("string"))
            out.append(df.where("v is not null").select("rec_id", "label", F.lit(path or "record").alias("schema_path"), F.lit(hops).alias("hops"), held.alias("fields")))
        if not isinstance(kind, StructType):
            return
        nested = {f.name: f.dataType for f in kind.fields if isinstance(f.dataType, (ArrayType, StructType))}
        steps = step_of(path, nested)
        for name, inner in nested.items():
            below = f"{path}.{name}" if path else name
            if paths is not None and not any(p == below or p.startswith(below + ".") for p in paths):
                continue
            spine = path == "" and name == SPINE
            base = F.col("label") if spine else F.concat("label", F.lit(f".{shift + steps[name]}"))
            if isinstance(inner, StructType):
                node(df.select("rec_id", base.alias("label"), F.col("v")[name].alias("v")), inner, below, 1)
            else:
                each = df.select("rec_id", base.alias("base"), F.posexplode(F.col("v")[name]).alias("place", "v")).where("v is not null")
                node(each.select("rec_id", F.concat("base", F.lit("."), F.col("place")).alias("label"), "v"), inner.elementType, below, 1 if spine else 2)

    node(record.select("rec_id", F.col("rec_id").cast("string").alias("label"), "v"), record.schema["v"].dataType, "", 0, shift=PLACES)
    union = out[0]
    for more in out[1:]:
        union = union.unionByName(more)
    return union


#: fields of a snapshot that are no part of the record: keys, and lists by seat
_BY_SEAT = ("discards", "melds", "reached", "furiten")


def snapshot_nodes(snapshots: DataFrame, paths: Collection[str] | None = None, fields: bool = True) -> DataFrame:
    """Nodes of the typed ``snapshots``, as ``state_nodes`` gives them.

    Seats are places in the outer arrays; short outer arrays leave the other
    seats without entries, nulls at any level make no node.
    """
    by_seat = [c for c in _BY_SEAT if c in snapshots.columns]
    rest = [c for c in STEPS[""] + ("bakaze", "kyoku", "honba", "kyotaku", "oya", "actor", "tsumo_pai", "actor_to_move", "remaining_wall") if c in snapshots.columns]
    if paths is not None and not fields:
        rest = [c for c in rest if c in paths]
        by_seat = [c for c in by_seat if any(p.startswith(f"{SPINE}.{c}") for p in paths)] or by_seat[:1]
    body = F.struct(*rest, *by_seat).alias("body")
    keyed = snapshots.select(F.col("snapshot_id").cast("bigint").alias("rec_id"), "loaded_at", body)
    record = latest(keyed, "rec_id", "body", F.xxhash64("body"))
    seat = lambda i: F.struct(*[F.get(F.col(f"body.{c}"), i).alias(c) for c in by_seat])
    players = F.array(*[seat(F.lit(i)) for i in range(PLACES)])
    shaped = record.select("rec_id", F.struct(*[F.col(f"body.{c}").alias(c) for c in rest], players.alias(SPINE)).alias("v"))
    return typed_nodes(shaped, paths, fields).select(F.lit("snapshot").alias("rec"), "rec_id", "label", "schema_path", "hops", "fields", F.lit(None).cast("map<int,int>").alias("seats"))


def owner(nodes: DataFrame) -> Column:
    """Label of the row a node belongs to, by truncation."""
    label = nodes["label"]
    return F.when(nodes["hops"] == 2, parent(parent(label))).otherwise(parent(label))


def seat(label: Column, seats: Column) -> Column:
    """Seat of the player whose label begins ``label``: as stated, else the place."""
    place = F.substring_index(F.substring_index(label, ".", 2), ".", -1).cast("int")
    return F.coalesce(F.try_element_at(seats, place), place)


def by_path(nodes: DataFrame, path: str, owned: str | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """The table of one schema path: keys, place and the named fields as columns.

    Below players it carries the ``seat``; seats other than 0 to 3 are left out
    (``left_out`` counts them).  Text that is no value of the type becomes null.
    """
    rows = nodes.where(F.col("schema_path") == path)
    below = path == SPINE or path.startswith(SPINE + ".")
    keys = ["rec", "rec_id", "label"]
    out = [F.col(k) for k in keys] + ([owner(rows).alias(owned)] if owned else []) + ([seat(F.col("label"), F.col("seats")).alias("seat")] if below else [])
    cast = [F.expr(f"try_cast(fields['{f}'] as {t})").alias(f) for f, t in (columns or {}).items()]
    made = rows.select(*out, last_step(F.col("label")).alias("place"), *cast)
    return made.where("seat between 0 and 3") if below else made


def tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """``records, seats, discards, melds`` of whole nodes, each with the label of its owner."""
    item = {"pai": "string", "value": "string"}
    discards = by_path(nodes, f"{SPINE}.discards", "seat_label", item | {"tsumogiri": "boolean", "reach_declared": "boolean"})
    melds = by_path(nodes, f"{SPINE}.melds", "seat_label", item | {"type": "string", "pai_raw": "string", "target": "int", "consumed": "string"})
    tile = lambda t: t.withColumn("pai", F.coalesce("pai", "value")).drop("value").withColumnRenamed("place", "item_no")
    return {
        "records": by_path(nodes, "record").drop("place"),
        "seats": by_path(nodes, SPINE, "record_label"),
        "discards": tile(discards),
        "melds": tile(melds).withColumn("consumed", F.from_json("consumed", "array<string>")),
    }


def left_out(states: DataFrame) -> DataFrame:
    """``reason, n``: payloads that are unreadable or null, and players beyond the four seats."""
    given = states.select(F.lit(0).cast("bigint").alias("rec_id"), F.lit(None).cast("timestamp").alias("loaded_at"), F.lit(0).cast("bigint").alias("tie"), "payload")
    read = given.where("payload is not null").mapInArrow(_shred((), False), _BODY).select(F.lit(0).alias("null"), F.lit(-1).alias("bad"))
    counted = given.select(F.col("payload").isNull().cast("int").alias("null"), F.col("payload").isNotNull().cast("int").alias("bad")).unionByName(read)
    totals = counted.agg(F.coalesce(F.sum("null"), F.lit(0)).alias("null"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    payloads = totals.select(F.explode(F.create_map(F.lit("null payload"), "null", F.lit("unreadable payload"), "bad")).alias("reason", "n"))
    players = state_nodes(states, [SPINE], False).where(~seat(F.col("label"), F.col("seats")).between(0, 3))
    return payloads.unionByName(players.agg(F.count("*").alias("n")).select(F.lit("player beyond the seats").alias("reason"), "n"))


def held_items(states: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``rec, rec_id, seat, kind, item_no`` of each discard and meld held.

    All three come from the label: the kind from its schema path, the place in the
    list from its last step, the seat from its beginning.
    """
    paths = [f"{SPINE}.discards", f"{SPINE}.melds"]
    nodes = state_nodes(states, paths, fields=False).unionByName(snapshot_nodes(snapshots, paths, fields=False))
    kind = F.when(F.col("schema_path") == paths[0], "discard").otherwise("meld")
    return nodes.select("rec", "rec_id", seat(F.col("label"), F.col("seats")).alias("seat"), kind.alias("kind"), last_step(F.col("label")).alias("item_no")).where("seat between 0 and 3")
