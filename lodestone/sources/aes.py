"""AES over many blocks at once with numpy: decryption in CBC mode, and counter mode with a little-endian counter."""

from __future__ import annotations

import numpy as np


def _tables():
    """S-box and its inverse, from inverses in GF(2^8) and the affine map."""
    power, log = [0] * 256, [0] * 256
    x = 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    box = np.zeros(256, np.uint8)
    for v in range(256):
        inv = power[(255 - log[v]) % 255] if v else 0
        out = 0x63
        for k in range(5):
            out ^= (inv << k | inv >> (8 - k)) & 0xFF
        box[v] = out
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256, dtype=np.uint8)
    times = lambda n: np.array([power[(log[n] + log[v]) % 255] if v else 0 for v in range(256)], np.uint8)
    return box, back, {n: times(n) for n in (2, 3, 9, 11, 13, 14)}


_BOX, _BACK, _TIMES = _tables()
_SHIFT = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])
_UNSHIFT = np.argsort(_SHIFT)


class AES:
    """Keys of 16, 24 or 32 bytes."""

    def __init__(self, key: bytes):
        n = len(key) // 4
        words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
        rcon = 1
        for i in range(n, 4 * (n + 7)):
            w = list(words[i - 1])
            if i % n == 0:
                w = [int(_BOX[b]) for b in w[1:] + w[:1]]
                w[0] ^= rcon
                rcon = (rcon << 1) ^ (0x11B if rcon & 0x80 else 0)
            elif n > 6 and i % n == 4:
                w = [int(_BOX[b]) for b in w]
            words.append([a ^ b for a, b in zip(words[i - n], w)])
        self.keys = np.array(words, np.uint8).reshape(-1, 16)

    @staticmethod
    def _mix(s: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
        t = s.reshape(-1, 4, 4)
        by = lambda n, v: v if n == 1 else _TIMES[n][v]
        out = np.empty_like(t)
        for r in range(4):
            out[:, :, r] = by(row[-r % 4], t[:, :, 0]) ^ by(row[(1 - r) % 4], t[:, :, 1]) ^ by(row[(2 - r) % 4], t[:, :, 2]) ^ by(row[(3 - r) % 4], t[:, :, 3])
        return out.reshape(-1, 16)

    def encrypt(self, blocks: np.ndarray) -> np.ndarray:
        s = blocks ^ self.keys[0]
        for k in self.keys[1:-1]:
            s = self._mix(_BOX[s][:, _SHIFT], (2, 3, 1, 1)) ^ k
        return _BOX[s][:, _SHIFT] ^ self.keys[-1]

    def decrypt(self, blocks: np.ndarray) -> np.ndarray:
        s = blocks ^ self.keys[-1]
        for k in self.keys[-2:0:-1]:
            s = self._mix(_BACK[s[:, _UNSHIFT]] ^ k, (14, 11, 13, 9))
        return _BACK[s[:, _UNSHIFT]] ^ self.keys[0]

    def cbc(self, data: bytes, iv: bytes) -> bytes:
        b = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
        if not len(b):
            return b""
        return (self.decrypt(b) ^ np.concatenate((np.frombuffer(iv, np.uint8)[None], b[:-1]))).tobytes()

    def ctr_le(self, data: bytes) -> bytes:
        n = -(-len(data) // 16)
        counter = np.zeros((n, 2), "<u8")
        counter[:, 0] = np.arange(1, n + 1)
        stream = self.encrypt(counter.view(np.uint8).reshape(-1, 16)).ravel()[: len(data)]
        return (np.frombuffer(data, np.uint8) ^ stream).tobytes()
