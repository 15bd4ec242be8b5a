"""SQL of the exact hash functions, step by step in wide integers, for queries whose rows depend on their bits."""

from __future__ import annotations

_32, _64 = 1 << 32, 1 << 64


def _steps(sql: str, steps: list[str]) -> str:
    """Each step computes a new ``h`` from the last one; other columns stay."""
    for step in steps:
        sql = f"SELECT * REPLACE ({step} AS h) FROM ({sql})"
    return sql


def _times(x: str, by: int) -> str:
    return f"({x} * {by}::HUGEINT) % {_32}"


def _turn(x: str, n: int) -> str:
    return f"((({x} << {n}) % {_32}) + ({x} >> {32 - n}))"


# UTF-16 units of a text ``t``: a code point beyond 16 bits is two.
_UNITS = """flatten(list_transform(list_filter(string_split(t, ''), lambda c: c <> ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [unicode(c)::HUGEINT]
  ELSE [(55296 + ((unicode(c) - 65536) // 1024))::HUGEINT, (56320 + (unicode(c) - 65536) % 1024)::HUGEINT] END))"""


def java_sql(rows: str) -> str:
    """(id, java) of rows (id, t): the 32-bit polynomial hash of the text's units, signed."""
    folded = f"list_reduce([0::HUGEINT] || {_UNITS}, lambda h, u: (h * 31 + u) % {_32})"
    return f"SELECT id, CAST(CASE WHEN h >= {_32 >> 1} THEN h - {_32} ELSE h END AS INTEGER) AS java FROM (SELECT id, {folded} AS h FROM ({rows}))"


def murmur_sql(rows: str, seeds: int) -> str:
    """(id, i, h) of rows (id, t): 32-bit Murmur3 over pairs of the text's units under the seeds below ``seeds``, signed. The multipliers are fixed values of the function."""
    mixed = lambda k: _times(_turn(f"({_times(k, 0xCC9E2D51)})", 15), 0x1B873593)
    pairs = "list_transform(range(0, len(u) // 2), lambda j: u[2 * j + 1] * 65536 + u[2 * j + 2])"
    body = f"list_reduce([i::HUGEINT] || list_transform({pairs}, lambda k: {mixed('k')}), lambda h, k: ({_turn('xor(h, k)', 13)} * 5 + {0xE6546B64}) % {_32})"
    start = f"SELECT id, i, u, {body} AS h FROM (SELECT id, {_UNITS} AS u FROM ({rows})), (SELECT unnest(range(0, {seeds})) AS i)"
    tail = f"CASE WHEN len(u) % 2 = 1 THEN xor(h, {mixed('u[len(u)]')}) ELSE h END"
    ends = [tail, "xor(h, len(u)::HUGEINT)", _times("xor(h, h >> 16)", 0x85EBCA6B), _times("xor(h, h >> 13)", 0xC2B2AE35), "xor(h, h >> 16)"]
    return f"SELECT id, CAST(i AS INTEGER) AS i, CASE WHEN h >= {_32 >> 1} THEN h - {_32} ELSE h END AS h FROM ({_steps(start, ends)})"


# Fixed values of 64-bit XXH: its five primes.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def xx64_sql(rows: str, seeds: int) -> str:
    """(id, i, u, h) of rows (id: a long, not negative): XXH64 of its eight bytes under the seeds below ``seeds``, unsigned and signed."""
    n = lambda x: f"{x}::UHUGEINT"
    times = lambda x, by: f"({x} * {n(by)}) % {n(_64)}"
    turn = lambda k: f"(((h << {n(k)}) % {n(_64)}) + (h >> {n(64 - k)}))"
    start = f"SELECT id, i, id::UHUGEINT AS h FROM ({rows}), (SELECT unnest(range(0, {seeds})) AS i)"
    ends = [
        times("h", _P2), times(turn(31), _P1), f"xor(h, ({n('i')} + {n(_P5 + 8)}) % {n(_64)})", f"({times(turn(27), _P1)} + {n(_P4)}) % {n(_64)}",
        times(f"xor(h, h >> {n(33)})", _P2), times(f"xor(h, h >> {n(29)})", _P3), f"xor(h, h >> {n(32)})",
    ]
    return f"SELECT id, CAST(i AS INTEGER) AS i, h AS u, CASE WHEN h >= {n(_64 >> 1)} THEN h::HUGEINT - {_64}::HUGEINT ELSE h::HUGEINT END AS h FROM ({_steps(start, ends)})"
