"""Keccak-256 with the original padding, on the driver, for literals only."""

from __future__ import annotations

_MASK = (1 << 64) - 1


def _round_constants() -> list[int]:
    """From the degree-8 LFSR of the specification."""
    out, lfsr = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            if lfsr & 1:
                c |= 1 << ((1 << j) - 1)
            lfsr = (lfsr << 1) ^ (0x171 if lfsr & 0x80 else 0)
        out.append(c)
    return out


_CONSTANTS = _round_constants()


def _rotate(x: int, n: int) -> int:
    return ((x << n) | (x >> (64 - n))) & _MASK if n % 64 else x


def _permute(a: list[list[int]]) -> None:
    for constant in _CONSTANTS:
        parity = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
        for x in range(5):
            d = parity[x - 1] ^ _rotate(parity[(x + 1) % 5], 1)
            a[x] = [v ^ d for v in a[x]]
        x, y, moving = 1, 0, a[1][0]
        for t in range(24):
            x, y = y, (2 * x + 3 * y) % 5
            a[x][y], moving = _rotate(moving, ((t + 1) * (t + 2) // 2) % 64), a[x][y]
        for y in range(5):
            row = [a[x][y] for x in range(5)]
            for x in range(5):
                a[x][y] = row[x] ^ (~row[(x + 1) % 5] & _MASK & row[(x + 2) % 5])
        a[0][0] ^= constant


def keccak256(data: bytes) -> bytes:
    rate = 136
    padded = bytearray(data + b"\x01" + b"\0" * (rate - 1 - len(data) % rate))
    padded[-1] |= 0x80
    a = [[0] * 5 for _ in range(5)]
    for at in range(0, len(padded), rate):
        for i in range(rate // 8):
            a[i % 5][i // 5] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        _permute(a)
    return b"".join(a[i % 5][i // 5].to_bytes(8, "little") for i in range(4))


def event_topic(signature: str) -> str:
    """The topic0 of an event signature, as written."""
    return "0x" + keccak256(signature.encode()).hex()


def address_topic(address: str) -> str:
    """An address as a 32-byte topic."""
    digits = address[2:] if address[:2] in ("0x", "0X") else address
    try:
        raw = bytes.fromhex(digits)
    except ValueError:
        raw = b""
    if len(raw) != 20 or len(digits) != 40:
        raise ValueError(f"not a 20-byte address: {address!r}")
    return "0x" + raw.rjust(32, b"\0").hex()
