"""Signing, capability tokens, encryption and identities, as columns; Ed25519 and X25519 after RFC 8032 and RFC 7748."""

from __future__ import annotations

import base64
import hashlib
import os
import secrets
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base64url(data: Column) -> Column:
    return F.rtrim(F.translate(F.base64(data), "+/", "-_"), F.lit("="))


def unbase64url(text: Column) -> Column:
    padded = F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), (-F.length(text)) % 4 + 4 * ((-F.length(text)) % 4 < 0).cast("int")))
    return F.unbase64(padded)


def sign_bytes(id_: Column, deps: Column, payload_type: Column, payload: Column, hlc: Column) -> Column:
    """What a signature covers, as binary: id, dependencies, type, payload and clock, joined by a bar."""
    bar = F.lit("|").cast("binary")
    b = lambda c: c.cast("string").cast("binary")
    return F.concat(b(id_), bar, b(F.array_join(deps, ",")), bar, b(payload_type), bar, payload, bar, b(hlc))


def rotate(key: Column) -> Column:
    """The next key: the SHA-256 digest of this one."""
    return F.unhex(F.sha2(key, 256))


def serialize_capability(resource: Column, permissions: Column, issuer: Column, subject: Column, expires: Column) -> Column:
    return F.concat_ws("|", resource, F.array_join(permissions, ","), issuer, subject, expires.cast("string"))


def expired(expires: Column, as_of: int) -> Column:
    """Whether a capability with an expiry (0: none) is past it at ``as_of`` seconds."""
    return (expires > 0) & (F.lit(as_of) > expires)


def needs_rotation(created: Column, max_age: int, as_of: int) -> Column:
    return (F.lit(as_of) - created) > max_age


def issue_capability(cap: dict, seed: bytes) -> str:
    """A token of ``cap`` (resource, permissions, issuer, subject, expires), signed."""
    return encode_token(cap, sign(seed, _capability_bytes(cap)))


def verify_capability(token: str, public: bytes, as_of: int) -> bool:
    """Whether a token's signature holds and it is not expired at ``as_of`` seconds."""
    cap, signature = decode_token(token)
    return not 0 < cap["expires"] < as_of and verify(public, _capability_bytes(cap), signature)


def _capability_bytes(cap: dict) -> bytes:
    return "|".join([cap["resource"], ",".join(cap["permissions"]), cap["issuer"], cap["subject"], str(cap["expires"])]).encode()


def save_identity(path: str, seed: bytes) -> None:
    """Writes a private key that only its owner may read."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), mode=0o700, exist_ok=True)
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
        f.write(_b64(seed + public_key(seed)))


def load_identity(path: str) -> bytes:
    with open(path) as f:
        data = _unb64(f.read().strip())
    if len(data) != 64 or public_key(data[:32]) != data[32:]:
        raise ValueError("not a private key")
    return data[:32]


def encode_token(cap: dict, signature: bytes) -> str:
    parts = [cap["resource"], ",".join(cap["permissions"]), cap["issuer"], cap["subject"], str(cap["expires"]), _b64(signature)]
    return _b64("\0".join(parts).encode())


def decode_token(token: str) -> tuple[dict, bytes]:
    parts = _unb64(token).decode().split("\0", 5)
    if len(parts) != 6:
        raise ValueError("a token has six parts")
    r, p, i, s, e, sig = parts
    return {"resource": r, "permissions": p.split(",") if p else [], "issuer": i, "subject": s, "expires": int(e)}, _unb64(sig)


def _b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def _unb64(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


# --- Ed25519 and X25519 -------------------------------------------------------------------------------------------

# The field, the group's order, and the base point.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)
BASE_Y = 4 * pow(5, P - 2, P) % P


def _x_of(y: int, sign: int) -> int | None:
    if y >= P:
        return None
    x2 = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(x2, (P + 3) // 8, P)
    if (x * x - x2) % P:
        x = x * ROOT % P
    if (x * x - x2) % P or (x == 0 and sign):
        return None
    return P - x if x & 1 != sign else x


def _add(p, q):
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


_BX = _x_of(BASE_Y, 0)
BASE = (_BX, BASE_Y, 1, _BX * BASE_Y % P)


@lru_cache(256)
def _table(p) -> list[list[tuple]]:
    """Multiples of ``p``: row i has d * 16^i times it for each digit d, so that a product is 64 sums."""
    out = []
    for _ in range(64):
        row = [(0, 1, 1, 0)]
        for _ in range(15):
            row.append(_add(row[-1], p))
        out.append(row)
        p = _add(row[-1], p)
    return out


def _times_known(n: int, p):
    """n * p for a point that comes again and again: the base point, or a known key."""
    out = (0, 1, 1, 0)
    for row in _table(p):
        if n & 15:
            out = _add(out, row[n & 15])
        n >>= 4
    return out


def _pack(p) -> bytes:
    z = pow(p[2], P - 2, P)
    return ((p[1] * z % P) | ((p[0] * z % P & 1) << 255)).to_bytes(32, "little")


def _unpack(data: bytes):
    n = int.from_bytes(data, "little")
    y, sign = n & ((1 << 255) - 1), n >> 255
    x = _x_of(y, sign)
    return None if x is None else (x, y, 1, x * y % P)


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return (int.from_bytes(h[:32], "little") & ((1 << 254) - 8)) | (1 << 254), h[32:]


@lru_cache(256)
def public_key(seed: bytes) -> bytes:
    return _pack(_times_known(_secret(seed)[0], BASE))


def _hash_int(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    pub, r = public_key(seed), _hash_int(prefix, message)
    big_r = _pack(_times_known(r, BASE))
    return big_r + ((r + _hash_int(big_r, pub, message) * a) % ORDER).to_bytes(32, "little")


_known_point = lru_cache(256)(_unpack)


def verify(public: bytes | None, message: bytes | None, signature: bytes | None) -> bool:
    if public is None or message is None or signature is None or len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _known_point(public), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    left, right = _times_known(s, BASE), _add(r, _times_known(_hash_int(signature[:32], public, message), a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0


def x25519(scalar: bytes, u: bytes) -> bytes:
    """The Montgomery ladder."""
    k = (int.from_bytes(scalar, "little") & ((1 << 254) - 8)) | (1 << 254)
    x1 = int.from_bytes(u, "little") & ((1 << 255) - 1)
    x2, z2, x3, z3, swap = 1, 0, x1, 1, 0
    for t in range(254, -1, -1):
        bit = k >> t & 1
        if swap ^ bit:
            x2, x3, z2, z3 = x3, x2, z3, z2
        swap = bit
        a, b, c, d = x2 + z2, x2 - z2, x3 + z3, x3 - z3
        aa, bb, da, cb = a * a % P, b * b % P, d * a % P, c * b % P
        x3, z3 = (da + cb) ** 2 % P, x1 * (da - cb) ** 2 % P
        x2, z2 = aa * bb % P, (aa - bb) * (aa + 121665 * (aa - bb)) % P
    if swap:
        x2, z2 = x3, z3
    return (x2 * pow(z2, P - 2, P) % P).to_bytes(32, "little")


def key_pair() -> tuple[bytes, bytes]:
    private = secrets.token_bytes(32)
    return private, x25519(private, (9).to_bytes(32, "little"))


def identity(seed: bytes) -> str:
    return _b64(public_key(seed))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out over all cores, whatever files or small shuffles they come from: for columns that take
    a good part of a millisecond a row."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def _plain(values) -> list[bytes | None]:
    return [None if v is None else bytes(v) for v in values]


def ed25519_verify(public: Column, message: Column, signature: Column) -> Column:
    def check(p, m, s):
        import pandas as pd

        from tidelog.functions import curve

        return pd.Series(curve.verify_all(_plain(p), _plain(m), _plain(s)), dtype=bool)

    return F.pandas_udf(check, "boolean")(public, message, signature)


def ed25519_sign(seed: bytes, message: Column) -> Column:
    def signed(m):
        import pandas as pd

        from tidelog.functions import curve

        return pd.Series(curve.sign_all(seed, _plain(m)), dtype=object)

    return F.pandas_udf(signed, "binary")(message)


def x25519_agree(private: Column, public: Column) -> Column:
    """What two sides agree on, of 32 bytes each; null where one is null or of another length."""
    def agree(k, u):
        import pandas as pd

        from tidelog.functions import curve

        k, u = _plain(k), _plain(u)
        at = [i for i, (a, b) in enumerate(zip(k, u, strict=True)) if a is not None and b is not None and len(a) == len(b) == 32]
        out = pd.Series([None] * len(k), dtype=object)
        for i, x in zip(at, curve.x25519_all([k[i] for i in at], [u[i] for i in at]), strict=True):
            out[i] = x
        return out

    return F.pandas_udf(agree, "binary")(private, public)


def nonce() -> str:
    """32 random bytes as text."""
    return _b64(secrets.token_bytes(32))


def salt() -> bytes:
    return secrets.token_bytes(32)


def encrypt_text(text: Column, key: Column) -> Column:
    """AES-GCM (nonce, text, tag) as base64url without padding."""
    return base64url(F.aes_encrypt(text.cast("binary"), key, F.lit("GCM")))


def decrypt_text(text: Column, key: Column) -> Column:
    """The inverse; null where it was encrypted under another key."""
    return F.try_aes_decrypt(unbase64url(text), key, F.lit("GCM")).cast("string")


def wrong_signature(public: Column, message: Column, signature: Column) -> Column:
    """Why an event is not to be trusted, or null."""
    reason = F.when(signature.isNull() | (F.length(signature) == 0), "no signature").when(F.length(public) != 32, "invalid public key")
    return F.coalesce(reason, F.when(~ed25519_verify(public, message, signature), "signature does not hold"))


def first_failure(reasons: DataFrame) -> DataFrame:
    """(seq, reason) of the first row with a reason."""
    # not a filter: it would be pushed below the signatures and reckon them twice
    wrong = F.when(F.col("reason").isNotNull(), F.col("seq"))
    return reasons.agg(F.min(wrong).alias("seq"), F.min_by("reason", wrong).alias("reason"), F.count("reason").alias("failures"))


def default_identity_path() -> str:
    """Where a node's key is kept unless told otherwise."""
    return os.path.join(os.path.expanduser("~"), ".tidelog", "identity.key")
