"""Actions of the 46-entry model space, tiles, and the 64-bit action code.

Fixed values stand together below, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names of the model's action space; 0..36 are discards
DISCARDS = 37
NAMES = {37: "reach", 38: "chi_low", 39: "chi_mid", 40: "chi_high", 41: "pon", 42: "kan", 43: "agari", 44: "ryukyoku", 45: "pass"}
# fixed values: tiles in index order
SUITS = "mps"
HONOURS = ("E", "S", "W", "N", "P", "F", "C")
TILES = [f"{n}{s}" for s in SUITS for n in range(1, 10)] + list(HONOURS)
RED = ("5mr", "5pr", "5sr")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def name(action) -> Column:
    """``discard``, a named action, or ``other``; null stays null."""
    a = _c(action)
    known = F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), a)
    return F.when(a.isNull(), None).when(a.between(0, DISCARDS - 1), "discard").otherwise(F.coalesce(known, F.lit("other")))


def plain_tile(tile) -> Column:
    """A red five as a plain one (trailing ``r`` cut); ``0m`` style fives too."""
    t = F.regexp_replace(_c(tile), "r$", "")
    return F.regexp_replace(t, "^0([mps])$", "5$1")


def keep_red(tile) -> Column:
    t = _c(tile)
    return F.when(t.isin(*RED), t).otherwise(plain_tile(t))


def is_red(tile) -> Column:
    return _c(tile).isin(*RED)


def tile34(tile) -> Column:
    """Index 0..33 of a tile, -1 for unknown ones and null."""
    index = F.create_map(*[F.lit(x) for kv in zip(TILES, range(34)) for x in kv])
    return F.coalesce(F.element_at(index, plain_tile(tile)), F.lit(-1))


def dora_of(marker) -> Column:
    """The tile that a dora marker points to; suits, winds and dragons wrap."""
    nxt = {}
    for i in range(27):
        nxt[i] = i // 9 * 9 + (i + 1) % 9
    for i in range(4):
        nxt[27 + i] = 27 + (i + 1) % 4
    for i in range(3):
        nxt[31 + i] = 31 + (i + 1) % 3
    at = tile34(marker)
    return F.when(at >= 0, F.element_at(F.create_map(*[F.lit(x) for kv in nxt.items() for x in kv]), at)).otherwise(-1)


def legal_mask(indices, size: int = 46) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(_c(indices), i))


# fixed values: radix of each field of the 64-bit code (absent tile or seat = 0)
RADIX = {"tile": 35, "target": 5, "flags": 256}


def encode(kind, tile, consumed, target, flags) -> Column:
    """Mixed-radix code of an action: type, tile, three consumed tiles, target, flags.

    Tiles and seats are shifted by one so that -1 (absent) becomes 0.
    """
    code = _c(kind).cast("bigint") * 35 + (_c(tile) + 1)
    for i in range(3):
        code = code * 35 + (F.coalesce(F.get(_c(consumed), F.lit(i)), F.lit(-1)) + 1)
    return (code * 5 + (_c(target) + 1)) * 256 + _c(flags)


def decode(code) -> dict[str, Column]:
    """The fields of ``encode`` back from its code."""
    rest = _c(code)

    def take(radix: int) -> Column:
        nonlocal rest
        low = F.pmod(rest, F.lit(radix))
        rest = ((rest - low) / F.lit(radix)).cast("bigint")
        return low

    flags, target = take(256), take(5) - 1
    consumed = [take(35) - 1 for _ in range(3)]
    tile, kind = take(35) - 1, rest
    return {"kind": kind, "tile": tile, "consumed": F.array(*reversed(consumed)), "target": target, "flags": flags}


def equivalent(kind_a, kind_b, pai_a, pai_b, consumed_a, consumed_b) -> Column:
    """Whether two actions are the same move.

    Discards compare tiles and ignore how they were drawn; wins ignore a missing
    tile; calls compare plain tiles as multisets.
    """
    same = _c(kind_a) == _c(kind_b)
    tiles = plain_tile(pai_a).eqNullSafe(plain_tile(pai_b))
    bag = lambda x: F.array_sort(F.transform(F.coalesce(_c(x), F.array().cast("array<string>")), plain_tile))
    k = _c(kind_a)
    return same & F.when(k == "dahai", _c(pai_a).eqNullSafe(_c(pai_b))).when(k == "hora", _c(pai_a).isNull() | _c(pai_b).isNull() | tiles).when(k.isin("chi", "pon", "daiminkan", "ankan", "kakan"), (bag(consumed_a) == bag(consumed_b)) & (tiles | _c(pai_a).isNull() | _c(pai_b).isNull())).otherwise(True)


def action_features(kind_id, tile, tsumogiri, in_hand, visible, wall) -> Column:
    """Eight normalised scalars of an action."""
    t, n = _c(tile), F.pmod(_c(tile), F.lit(9))
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return F.array(
        _c(kind_id).cast("double"), F.when(t >= 0, t / F.lit(33.0)).otherwise(0.0), flag(_c(tsumogiri)), F.least(F.lit(1.0), _c(in_hand) / 4.0), F.least(F.lit(1.0), _c(visible) / 4.0),
        flag(t >= 27), flag((t >= 0) & (t < 27) & n.isin(0, 8)), _c(wall) / 70.0,
    )


# fixed values: the 45-entry action space, discards first
INDEX45 = {"reach": 34, "chi_low": 35, "chi_mid": 36, "chi_high": 37, "pon": 38, "daiminkan": 39, "ankan": 40, "kakan": 41, "hora": 42, "ryukyoku": 43, "none": 44}


def chi_kind(pai, consumed) -> Column:
    """``chi_low``, ``chi_mid`` or ``chi_high``: where the called tile stands among the two used."""
    rank = lambda t: F.substring(plain_tile(t), 1, 1).cast("int")
    used = F.array_sort(F.transform(_c(consumed), rank))
    return F.when(rank(pai) < used[0], "chi_low").when(rank(pai) < used[1], "chi_mid").when(rank(pai).isNotNull() & (F.size(used) == 2), "chi_high")


def index45(kind, pai, consumed) -> Column:
    """Index of an action in the 45-entry space; an unknown discard tile gives null."""
    k = F.when(_c(kind) == "chi", chi_kind(pai, consumed)).otherwise(_c(kind))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in INDEX45.items() for x in kv]), k)
    at = tile34(pai)
    return F.when(_c(kind) == "dahai", F.when(at >= 0, at)).otherwise(F.coalesce(named, F.lit(INDEX45["none"])))


def wire_events(kind, actor, pai, consumed, target) -> Column:
    """The events that an action becomes: a declaration is followed by its discard."""
    event = lambda k, p: F.struct(k.alias("type"), _c(actor).alias("actor"), p.alias("pai"), _c(consumed).alias("consumed"), _c(target).alias("target"))
    k, p = _c(kind), _c(pai)
    none = F.lit(None).cast("string")
    return F.when((k == "reach") & p.isNotNull(), F.array(event(F.lit("reach"), none), event(F.lit("dahai"), p))).when(k == "none", F.array().cast("array<struct<type:string,actor:int,pai:string,consumed:array<string>,target:int>>")).otherwise(F.array(event(k, p)))


def train_seat(seed, key) -> Column:
    """Seat from a seed and the key rotated left by 13 bits, modulo 4."""
    k = _c(key).cast("bigint")
    turned = F.shiftleft(k, 13).bitwiseOR(F.shiftrightunsigned(k, 51))
    return F.pmod(_c(seed).cast("bigint").bitwiseXOR(turned).bitwiseAND(F.lit(3).cast("bigint")), F.lit(4)).cast("int")


def sub_multiset(part, whole) -> Column:
    """Whether every tile of ``part`` is in ``whole`` at least as often."""
    many = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    return F.forall(_c(part), lambda t: many(_c(part), t) <= many(_c(whole), t))


def scene_tile(tile) -> Column:
    """Label of a tile in the model space: red fives stand apart, at 34 to 36."""
    t = _c(tile)
    red = F.element_at(F.create_map(*[F.lit(x) for kv in zip(RED, range(34, 37)) for x in kv]), t)
    return F.coalesce(red, tile34(t))


def scene_chi(pai, consumed) -> Column:
    """38, 39 or 40 by the distances of the used tiles from the called one; null if they form no run."""
    base, suit = F.substring(plain_tile(pai), 1, 1).cast("int"), F.substring(plain_tile(pai), 2, 1)
    same = F.filter(F.transform(_c(consumed), plain_tile), lambda t: F.substring(t, 2, 1) == suit)
    far = F.array_sort(F.transform(same, lambda t: F.substring(t, 1, 1).cast("int") - base))
    is_ = lambda a, b: (F.size(far) == 2) & (far[0] == a) & (far[1] == b)
    return F.when(base.isNotNull(), F.when(is_(1, 2), 38).when(is_(-1, 1), 39).when(is_(-2, -1), 40))


def spec(event) -> Column:
    """The fields of an event that make up an action: kind, tile, used tiles, target, draw flag."""
    e = _c(event)
    pai = F.coalesce(e["pai"], F.get(e["consumed"], F.lit(0)))
    return F.struct(e["type"].alias("kind"), pai.alias("pai"), F.transform(F.coalesce(e["consumed"], F.array().cast("array<string>")), keep_red).alias("consumed"), e["target"].alias("target"))


def permute_suits(values, order) -> Column:
    """A vector over tiles (and what follows them) with its three suits in another order."""
    v = _c(values)
    parts = [F.slice(v, 9 * i + 1, 9) for i in order]
    return F.concat(*parts, F.slice(v, 28, F.greatest(F.size(v) - 27, F.lit(0))))


def permute_action(action, order) -> Column:
    """The action that a discard becomes when suits change places; others stay."""
    a = _c(action)
    place = F.element_at(F.create_map(*[F.lit(x) for new, old in enumerate(order) for x in (old, new)]), (a / 9).cast("int"))
    return F.when(a < 27, place * 9 + F.pmod(a, F.lit(9))).otherwise(a)


def role(label, roles: list[str], whole: list[str] | None = None) -> Column:
    """The role a label begins with (``M0_x`` is ``M0``); labels in ``whole`` stand for themselves, others raise."""
    x, out = _c(label), F.when(_c(label).isin(*(whole or [""])), _c(label))
    for r in roles:
        out = out.when(x.startswith(f"{r}_"), r)
    return out.when(x.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), x)))


def family(label, aliases: dict[str, str]) -> Column:
    """A label by its family name, or itself."""
    x = _c(label)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in aliases.items() for y in kv]), x), x)


def strict_label(action, mask) -> Column:
    """The action, if the mask allows it; one that is not allowed raises when read."""
    a = _c(action)
    return F.when(a.isNull() | F.coalesce(F.get(_c(mask), a), F.lit(False)), a).otherwise(F.raise_error(F.concat(F.lit("action is not legal: "), a.cast("string"))))


def terminal_action(legal, forced: list[str]) -> Column:
    """The first legal action ``struct<type, ...>`` whose type, in any case, is one of ``forced``."""
    return F.get(F.filter(_c(legal), lambda a: F.lower(a["type"]).isin(*[f.lower() for f in forced])), F.lit(0))
