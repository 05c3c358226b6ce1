"""Content hashes and hash-driven draws."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed value: prefix of the exploration contract's hash input
CONTRACT = "D3_top2_discard_v1"


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from SHA-256: its first eight bytes, little endian, over 2^64."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    hexed = F.sha2(text, 256)
    turned = F.concat(*[F.substring(hexed, i, 2) for i in range(15, 0, -2)])
    return F.conv(turned, 16, 10).cast("double") / F.lit(18446744073709551616.0)


def exploration_u(generation_seed="generation_seed", seed_key="seed_key", seat="seat", segment="kyoku_index", decision="decision_index") -> Column:
    return uniform(CONTRACT, *[F.col(c) for c in (generation_seed, seed_key, seat, segment, decision)])


def canonical_event(event: dict) -> str | None:
    """An event without ``meta`` and player names, keys sorted, compact."""
    kept = {k: v for k, v in event.items() if k != "meta" and not (event.get("type") == "start_game" and k == "names")}
    return json.dumps(kept, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_line(lines: pd.Series) -> pd.Series:
    """Canonical form of NDJSON lines; null for lines that are not JSON objects."""

    def one(line):
        try:
            event = json.loads(line)
        except (TypeError, ValueError):
            return None
        return canonical_event(event) if isinstance(event, dict) else None

    return lines.map(one)


@F.pandas_udf(T.StringType())
def state_hash(obs: pd.Series, mask: pd.Series) -> pd.Series:
    """blake2b-128 (hex) of the observation as 32-bit floats and the mask as bytes."""
    import numpy as np

    def one(o, m):
        if o is None or m is None:
            return None
        return hashlib.blake2b(np.asarray(o, np.float32).tobytes() + np.asarray(m, np.bool_).tobytes(), digest_size=16).hexdigest()

    return pd.Series([one(o, m) for o, m in zip(obs, mask)])


@F.pandas_udf(T.StringType())
def decision_hash(obs: pd.Series, mask: pd.Series, action: pd.Series) -> pd.Series:
    """``state_hash`` with the action behind it, as two bytes, low byte first."""
    import numpy as np

    def one(o, m, a):
        if o is None or m is None or a is None or a != a:
            return None
        return hashlib.blake2b(np.asarray(o, np.float32).tobytes() + np.asarray(m, np.bool_).tobytes() + int(a).to_bytes(2, "little"), digest_size=16).hexdigest()

    return pd.Series([one(o, m, a) for o, m, a in zip(obs, mask, action)])
