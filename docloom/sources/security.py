"""The standard security handler of PDF files: keys from passwords, RC4 and 128-bit AES.

Files of revisions 2 to 4 open with their user or owner password; files are written
in revision 4 with AES.  Tables of the cipher are made from its field arithmetic.
"""

from __future__ import annotations

import hashlib
import os
import struct

import numpy as np

#: Fixed value: the padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
ROUNDS = 10


def doubled(x: int) -> int:
    return (x << 1) ^ (0x11B if x & 0x80 else 0)


def field_tables() -> tuple[list[int], list[int]]:
    """Logarithms and powers of 3 in the cipher's field."""
    power, log, x = [0] * 255, [0] * 256, 1
    for k in range(255):
        power[k], log[x] = x, k
        x ^= doubled(x)
    return log, power


LOG, POWER = field_tables()


def times(a: int, b: int) -> int:
    return POWER[(LOG[a] + LOG[b]) % 255] if a and b else 0


def substitution() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for x in range(256):
        inverse = POWER[(255 - LOG[x]) % 255] if x else 0
        out[x] = 0x63 ^ inverse ^ (inverse << 1 | inverse >> 7) & 255 ^ (inverse << 2 | inverse >> 6) & 255 ^ (inverse << 3 | inverse >> 5) & 255 ^ (inverse << 4 | inverse >> 4) & 255
    return out


BOX = substitution()
UNBOX = np.argsort(BOX).astype(np.uint8)
BY = {n: np.array([times(x, n) for x in range(256)], np.uint8) for n in (2, 3, 9, 11, 13, 14)}
#: Places of a block's bytes, column by column, after the rows have turned right by their number.
BACK = np.array([(c - r) % 4 * 4 + r for c in range(4) for r in range(4)])


def round_keys(key: bytes) -> np.ndarray:
    words = [list(key[k : k + 4]) for k in range(0, 16, 4)]
    mark = 1
    for k in range(4, 4 * (ROUNDS + 1)):
        last = words[-1]
        if k % 4 == 0:
            last = [int(BOX[x]) for x in (*last[1:], last[0])]
            last[0] ^= mark
            mark = doubled(mark)
        words.append([a ^ b for a, b in zip(words[k - 4], last, strict=True)])
    return np.array(words, np.uint8).reshape(ROUNDS + 1, 16)


def mixed_columns(block: np.ndarray, a: int, b: int, c: int, d: int) -> np.ndarray:
    by = lambda n, x: x if n == 1 else BY[n][x]
    x = block.reshape(-1, 4, 4)
    out = np.empty_like(x)
    for r in range(4):
        out[..., r] = by(a, x[..., r]) ^ by(b, x[..., (r + 1) % 4]) ^ by(c, x[..., (r + 2) % 4]) ^ by(d, x[..., (r + 3) % 4])
    return out.reshape(block.shape)


def decrypted_blocks(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    x = blocks ^ keys[ROUNDS]
    for k in range(ROUNDS - 1, -1, -1):
        x = UNBOX[x[:, BACK]] ^ keys[k]
        x = mixed_columns(x, 14, 11, 13, 9) if k else x
    return x


def aes_decrypt(key: bytes, data: bytes) -> bytes:
    """Cipher block chaining with the first block before all others, and padding at the end."""
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    if len(blocks) < 2:
        return b""
    out = (decrypted_blocks(blocks[1:], round_keys(key)) ^ blocks[:-1]).tobytes()
    return out[: -out[-1]] if 1 <= out[-1] <= 16 else out


def round_tables() -> list[list[int]]:
    """For each row the word that a byte adds to its column: substitution and mixing in one."""
    first = [times(int(x), 2) << 24 | int(x) << 16 | int(x) << 8 | times(int(x), 3) for x in BOX]
    turn = lambda w, n: (w >> 8 * n | w << 32 - 8 * n) & 0xFFFFFFFF
    return [[turn(w, n) for w in first] for n in range(4)]


TABLES = round_tables()


def aes_encrypt(key: bytes, data: bytes, start: bytes | None = None) -> bytes:
    """The other way round; each block waits for the one before, so blocks go one by one, in words."""
    start = os.urandom(16) if start is None else start
    n = 16 - len(data) % 16
    words = struct.unpack(f">{(len(data) + n) // 4}I", data + bytes((n,)) * n)
    keys = struct.unpack(f">{4 * ROUNDS + 4}I", round_keys(key).tobytes())
    t0, t1, t2, t3 = TABLES
    box = BOX.tolist()
    last, out = struct.unpack(">4I", start), [*struct.unpack(">4I", start)]
    for at in range(0, len(words), 4):
        a, b, c, d = (words[at + k] ^ last[k] ^ keys[k] for k in range(4))
        for k in range(4, 4 * ROUNDS, 4):
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ keys[k],
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ keys[k + 1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ keys[k + 2],
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ keys[k + 3],
            )
        x = (a, b, c, d)
        last = tuple((box[x[k] >> 24] << 24 | box[x[(k + 1) % 4] >> 16 & 255] << 16 | box[x[(k + 2) % 4] >> 8 & 255] << 8 | box[x[(k + 3) % 4] & 255]) ^ keys[4 * ROUNDS + k] for k in range(4))
        out += last
    return struct.pack(f">{len(out)}I", *out)


def rc4(key: bytes, data: bytes) -> bytes:
    state, j = list(range(256)), 0
    for i in range(256):
        j = (j + state[i] + key[i % len(key)]) & 255
        state[i], state[j] = state[j], state[i]
    i = j = 0
    out = bytearray(len(data))
    for k, c in enumerate(data):
        i = (i + 1) & 255
        x = state[i]
        j = (j + x) & 255
        state[i], state[j] = state[j], x
        out[k] = c ^ state[(state[i] + x) & 255]
    return bytes(out)


def md5(data: bytes) -> bytes:
    return hashlib.md5(data, usedforsecurity=False).digest()


def padded(password: str) -> bytes:
    return (password.encode("cp1252", "replace") + PAD)[:32]


def repeated_rc4(key: bytes, data: bytes, order) -> bytes:
    for k in order:
        data = rc4(bytes(b ^ k for b in key), data)
    return data


class Handler:
    """What opens and closes the strings and streams of one file."""

    def __init__(self, revision: int, length: int, owner: bytes, user: bytes, permissions: int, file_id: bytes, aes: bool, metadata: bool = True):
        self.revision, self.length, self.owner, self.user = revision, length, owner, user
        self.permissions, self.file_id, self.aes, self.metadata = permissions, file_id, aes, metadata
        self.key = b""

    def key_of(self, password: bytes) -> bytes:
        value = md5(password + self.owner + struct.pack("<I", self.permissions & 0xFFFFFFFF) + self.file_id + (b"" if self.metadata or self.revision < 4 else b"\xff" * 4))
        for _ in range(50 if self.revision >= 3 else 0):
            value = md5(value[: self.length])
        return value[: self.length]

    def user_entry(self, key: bytes) -> bytes:
        if self.revision == 2:
            return rc4(key, PAD)
        return repeated_rc4(key, md5(PAD + self.file_id), range(20)) + b"\0" * 16

    def owner_key(self, password: str) -> bytes:
        value = md5(padded(password))
        for _ in range(50 if self.revision >= 3 else 0):
            value = md5(value)
        return value[: self.length]

    def opened(self, password: str) -> bool:
        """Whether the password, as a user's or an owner's, opens the file."""
        own = self.owner_key(password)
        as_owner = rc4(own, self.owner) if self.revision == 2 else repeated_rc4(own, self.owner, range(19, -1, -1))
        for given in (padded(password), as_owner):
            key = self.key_of(given)
            if self.user_entry(key)[:16] == self.user[:16]:
                self.key = key
                return True
        return False

    def object_key(self, number: int, generation: int = 0) -> bytes:
        salt = b"sAlT" if self.aes else b""
        return md5(self.key + struct.pack("<I", number)[:3] + struct.pack("<I", generation)[:2] + salt)[: min(16, self.length + 5)]

    def decrypt(self, data: bytes, number: int) -> bytes:
        return (aes_decrypt if self.aes else rc4)(self.object_key(number), data)

    def encrypt(self, data: bytes, number: int) -> bytes:
        return (aes_encrypt if self.aes else rc4)(self.object_key(number), data)


def new_handler(user: str, owner: str | None, file_id: bytes) -> Handler:
    """Revision 4 with AES and no permissions; the owner's password is the user's by default."""
    handler = Handler(4, 16, b"", b"", -3904, file_id, True)
    handler.owner = repeated_rc4(handler.owner_key(owner or user), padded(user), range(20))
    handler.key = handler.key_of(padded(user))
    handler.user = handler.user_entry(handler.key)
    return handler
