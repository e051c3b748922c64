"""Writes small ONNX models (protobuf messages), as the onnx package is not there."""

from __future__ import annotations

import numpy as np

_TYPES = {"float": 1, "int32": 6, "int64": 7}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, what: bytes | str) -> bytes:
    what = what.encode() if isinstance(what, str) else what
    return _varint(field << 3 | 2) + _varint(len(what)) + what


def _tensor(name: str, a: np.ndarray) -> bytes:
    kind = {"float32": "float"}.get(a.dtype.name, a.dtype.name)
    return b"".join(_number(1, d) for d in a.shape) + _number(2, _TYPES[kind]) + _bytes(8, name) + _bytes(9, a.tobytes())


def _value(name: str, kind: str, shape: list[int | str]) -> bytes:
    dims = b"".join(_bytes(1, _bytes(2, d) if isinstance(d, str) else _number(1, d)) for d in shape)
    return _bytes(1, name) + _bytes(2, _bytes(1, _number(1, _TYPES[kind]) + _bytes(2, dims)))


def node(op: str, ins: list[str], outs: list[str], **attributes: int | list[int] | bytes) -> bytes:
    """A node; an attribute is an integer, a list of them or a graph."""
    out = b"".join(_bytes(1, x) for x in ins) + b"".join(_bytes(2, x) for x in outs) + _bytes(4, op)
    for name, v in attributes.items():
        if isinstance(v, bytes):
            value = _bytes(6, v) + _number(20, 5)
        elif isinstance(v, list):
            value = b"".join(_number(8, x) for x in v) + _number(20, 7)
        else:
            value = _number(3, v) + _number(20, 2)
        out += _bytes(5, _bytes(1, name) + value)
    return out


def graph(nodes: list[bytes], weights: dict[str, np.ndarray], ins: list[tuple], outs: list[tuple]) -> bytes:
    """A graph; inputs and outputs are (name, type, shape)."""
    return (b"".join(_bytes(1, x) for x in nodes) + _bytes(2, "graph") + b"".join(_bytes(5, _tensor(k, a)) for k, a in weights.items())
            + b"".join(_bytes(11, _value(*x)) for x in ins) + b"".join(_bytes(12, _value(*x)) for x in outs))


def model(of: bytes) -> bytes:
    return _number(1, 9) + _bytes(8, _bytes(1, "") + _number(2, 18)) + _bytes(7, of)
