"""SipHash-2-4, as published by Aumasson and Bernstein."""

M = (1 << 64) - 1


def siphash(k0: int, k1: int, data: bytes) -> int:
    """64-bit keyed hash of data."""
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]  # "somepseudorandomlygeneratedbytes"

    def mix(rounds: int) -> None:
        a, b, c, d = v
        for _ in range(rounds):
            a = (a + b) & M
            b = ((b << 13 | b >> 51) & M) ^ a
            a = (a << 32 | a >> 32) & M
            c = (c + d) & M
            d = ((d << 16 | d >> 48) & M) ^ c
            a = (a + d) & M
            d = ((d << 21 | d >> 43) & M) ^ a
            c = (c + b) & M
            b = ((b << 17 | b >> 47) & M) ^ c
            c = (c << 32 | c >> 32) & M
        v[:] = a, b, c, d

    whole = len(data) // 8 * 8
    words = [int.from_bytes(data[k : k + 8], "little") for k in range(0, whole, 8)]
    for m in [*words, int.from_bytes(data[whole:], "little") | (len(data) & 255) << 56]:
        v[3] ^= m
        mix(2)
        v[0] ^= m
    v[2] ^= 255
    mix(4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]
