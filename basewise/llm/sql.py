"""Parts of DuckDB SQL that several queries need."""


def crc32(value: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = "x"
    for _ in range(8):
        bits = f"list_transform([{bits}], lambda c: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)[1]"
    codes = f"list_transform(string_split({value}, ''), lambda s: CAST(ord(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: list_transform([xor(a, b)], lambda x: {bits})[1]), 4294967295)"
