"""Keccak-256 (the padding of the original submission, not that of SHA3-256)."""

from __future__ import annotations

_MASK = (1 << 64) - 1


def _constants() -> tuple[list[int], list[list[int]]]:
    """Round constants from the degree-8 shift register, rotations from the lane walk of the specification."""
    state, rounds = 1, []
    for _ in range(24):
        c = 0
        for j in range(7):
            if state & 1:
                c |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state & 0x80 else 0)
        rounds.append(c)
    turn = [[0] * 5 for _ in range(5)]
    x, y = 1, 0
    for t in range(24):
        turn[x][y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return rounds, turn


_ROUNDS, _TURN = _constants()


def _left(v: int, n: int) -> int:
    return ((v << n) | (v >> (64 - n))) & _MASK if n else v


def _permute(a: list[list[int]]) -> list[list[int]]:
    for constant in _ROUNDS:
        parity = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
        a = [[a[x][y] ^ parity[x - 1] ^ _left(parity[(x + 1) % 5], 1) for y in range(5)] for x in range(5)]
        b = [[0] * 5 for _ in range(5)]
        for x in range(5):
            for y in range(5):
                b[y][(2 * x + 3 * y) % 5] = _left(a[x][y], _TURN[x][y])
        a = [[b[x][y] ^ (~b[(x + 1) % 5][y] & _MASK & b[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
        a[0][0] ^= constant
    return a


def keccak256(data: bytes) -> bytes:
    rate = 136
    padded = bytearray(data) + b"\x01" + bytes(-(len(data) + 1) % rate)
    padded[-1] |= 0x80
    state = [[0] * 5 for _ in range(5)]
    for at in range(0, len(padded), rate):
        for k in range(rate // 8):
            state[k % 5][k // 5] ^= int.from_bytes(padded[at + 8 * k : at + 8 * k + 8], "little")
        state = _permute(state)
    return b"".join(state[k % 5][k // 5].to_bytes(8, "little") for k in range(4))
