"""CRC-32 as DuckDB SQL, for the SQL that results are compared with. No operator uses it."""

from __future__ import annotations

#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Bytes of a piece of a long text.
PIECE = 64
START = "4294967295::UBIGINT"


def _pushed(register: int, bits: int) -> int:
    """The register after so many zero bits."""
    for _ in range(bits):
        register = (register >> 1) ^ (POLYNOMIAL if register & 1 else 0)
    return register


def _list(values) -> str:
    return "[" + ", ".join(f"{v}::UBIGINT" for v in values) + "]"


def _register(digits: str, start: str) -> str:
    """The register after the bytes whose hexadecimal digits are given, the low digit of each byte first."""
    codes = f"list_transform(range(1, len({digits}) + 1), lambda i: (instr('0123456789ABCDEF', {digits}[i + 2 * (i % 2) - 1]) - 1)::UBIGINT)"
    return f"list_reduce({codes}, lambda s, b: xor(s >> 4, {_list(_pushed(v, 4) for v in range(16))}[(xor(s, b) & 15)::INT + 1]), {start})"


def short_crc32(text: str) -> str:
    """The CRC-32 of short texts, as an expression."""
    return f"xor({_register(f'hex(encode({text}))', START)}, {START})::BIGINT"


def long_crc32(table: str, key: str, text: str) -> str:
    """Common table expressions that end with crc(key, text_crc32): of each row of a table, whose key is unique, by pieces.

    A text is its first few bytes and whole pieces; registers of whole pieces start at 0, as the
    register is linear: pushing it over a piece is pushing it over zeros and adding the piece's own.
    """
    moved = "0::UBIGINT"
    for j in range(8):
        moved = f"xor({moved}, {_list(_pushed(v << 4 * j, 8 * PIECE) for v in range(16))}[((s >> {4 * j}) & 15)::INT + 1])"
    return f"""hx AS (SELECT {key}, hex(encode(coalesce({text}, ''))) AS x FROM {table}),
pc AS (SELECT {key}, k, CASE WHEN k = 0 THEN x[1:len(x) % {2 * PIECE}] ELSE x[len(x) % {2 * PIECE} + {2 * PIECE} * (k - 1) + 1:len(x) % {2 * PIECE} + {2 * PIECE} * k] END AS p
  FROM (SELECT {key}, x, unnest(range(len(x) // {2 * PIECE} + 1)) AS k FROM hx)),
rg AS (SELECT {key}, k, {_register("p", f"CASE WHEN k = 0 THEN {START} ELSE 0::UBIGINT END")} AS r FROM pc),
crc AS (SELECT {key}, xor(list_reduce(list(r ORDER BY k), lambda s, p: xor({moved}, p)), {START})::BIGINT AS text_crc32 FROM rg GROUP BY {key})"""
