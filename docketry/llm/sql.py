"""DuckDB expressions shared by the SQL of the queries."""

from __future__ import annotations


def _step(value: int, bits: int = 4) -> int:
    for _ in range(bits):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of the UTF-8 bytes of ``text``, half a byte at a time (the low half first)."""
    halves = f"list_transform(range(1, length(hex({text})) + 1), lambda i: instr('0123456789ABCDEF', substr(hex({text}), i + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END, 1)) - 1)"
    steps = "[" + ", ".join(str(_step(n)) for n in range(16)) + "]"
    folded = f"list_reduce(list_concat([4294967295], {halves}), lambda c, b: xor(c >> 4, {steps}[(xor(c, b) & 15) + 1]))"
    return f"xor({folded}, 4294967295)"
