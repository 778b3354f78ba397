"""The self-attention layer's sums as two ONNX graphs: gradients of a batch of windows, and log probabilities of classes.

onnxruntime runs them with fused softmaxes and products that cost less a window than numpy's. Where it isn't installed,
scoring.py does the same sums in numpy. The graphs are written by hand, as messages of ONNX's protocol (field numbers of
onnx.proto), so that no further library is needed.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

_KINDS = {"<f4": 1, "<i8": 7}


def _varint(n: int) -> bytes:
    out, n = bytearray(), n & 0xFFFFFFFFFFFFFFFF
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _attribute(name: str, value) -> bytes:
    if isinstance(value, float):
        return _bytes(1, name) + _varint(2 << 3 | 5) + struct.pack("<f", value) + _number(20, 1)
    if isinstance(value, str):
        return _bytes(1, name) + _bytes(4, value) + _number(20, 3)
    return _bytes(1, name) + _number(3, value) + _number(20, 2)


def _constant(name: str, value: np.ndarray) -> bytes:
    return b"".join(_number(1, n) for n in value.shape) + _number(2, _KINDS[value.dtype.str]) + _bytes(8, name) + _bytes(9, value.tobytes())


class _Graph:
    def __init__(self, **inputs: str):
        self.nodes, self.constants, self.names, self.inputs = [], [], 0, inputs

    def _named(self) -> str:
        self.names += 1
        return f"t{self.names}"

    def constant(self, value, kind: str) -> str:
        name = self._named()
        self.constants.append(_constant(name, np.asarray(value, kind)))
        return name

    def add(self, kind: str, *inputs: str, domain: str = "", **attributes) -> str:
        name = self._named()
        told = b"".join(_bytes(1, i) for i in inputs) + _bytes(2, name) + _bytes(4, kind)
        self.nodes.append(told + b"".join(_bytes(5, _attribute(k, v)) for k, v in attributes.items()) + _bytes(7, domain))
        return name

    def session(self, *outputs: str):
        import onnxruntime

        value = lambda name, kind: _bytes(1, name) + _bytes(2, _bytes(1, _number(1, _KINDS[kind])))
        graph = b"".join(_bytes(1, n) for n in self.nodes) + _bytes(2, "layer") + b"".join(_bytes(5, c) for c in self.constants)
        graph += b"".join(_bytes(11, value(*i)) for i in self.inputs.items()) + b"".join(_bytes(12, value(o, "<f4")) for o in outputs)
        model = _number(1, 8) + _bytes(7, graph) + _bytes(8, _bytes(1, "") + _number(2, 18)) + _bytes(8, _bytes(1, "com.microsoft") + _number(2, 1))
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        options.enable_mem_pattern = False  # the number of distinct ids differs from step to step
        options.log_severity_level = 3
        return onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])


def _scores(g: _Graph, queries: str, keys: str, bias: str, steepest: float) -> str:
    s = g.add("FusedMatMul", queries, keys, domain="com.microsoft", transB=1)
    s = g.add("Clip", s, g.constant(-steepest, "<f4"), g.constant(steepest, "<f4"))
    return g.add("Softmax", g.add("Add", s, bias), axis=-1)


def _logits(g: _Graph, mixed: str, most: float) -> str:
    return g.add("Clip", g.add("Gemm", mixed, "w", "b"), "", g.constant(most, "<f4"))


@functools.cache
def gradients(places: int, width: int, steepest: float, most: float):
    """own (embeddings of distinct ids), at (which of them each place of each window has), m (queries and keys), w (values and
    classes), b, bias (by places), y, part (of each place in the loss; both as columns) -> gradients of m, w and b, summed
    gradients of scores by places, gradients of own. None where onnxruntime can't run it."""
    g = _Graph(own="<f4", at="<i8", m="<f4", w="<f4", b="<f4", bias="<f4", y="<i8", part="<f4")
    flat, cube = g.constant([-1, width], "<i8"), g.constant([-1, places, width], "<i8")
    per_row, first, last = g.constant([-1, 1], "<i8"), g.constant([0], "<i8"), g.constant([-1], "<i8")
    product = functools.partial(g.add, "FusedMatMul", domain="com.microsoft")
    h, t = g.add("Gather", "own", "at"), g.add("Gather", g.add("MatMul", "own", "m"), "at")
    s = _scores(g, t, h, "bias", steepest)
    mixed = g.add("Reshape", g.add("MatMul", s, h), flat)
    p = g.add("Mul", g.add("Softmax", _logits(g, mixed, most), axis=-1), "part")
    p = g.add("ScatterElements", p, "y", g.add("Neg", "part"), axis=1, reduction="add")
    back = g.add("Gemm", p, "w", transB=1)
    mean = g.add("ReduceSum", g.add("Mul", back, mixed), last)  # of a place's gradients by its shares
    back = g.add("Reshape", back, cube)
    mean = g.add("Reshape", mean, g.constant([-1, places, 1], "<i8"))
    ds = g.add("Mul", g.add("Sub", product(back, h, transB=1), mean), s)
    zeros, rows = g.add("ConstantOfShape", g.add("Shape", "own")), g.add("Reshape", "at", per_row)
    by_id = lambda x: g.add("ScatterND", zeros, rows, g.add("Reshape", x, flat), reduction="add")
    dt = by_id(g.add("MatMul", ds, h))
    de = g.add("Gemm", dt, "m", by_id(g.add("Add", product(ds, t, transA=1), product(s, back, transA=1))), transB=1)
    dm, dw = g.add("Gemm", "own", dt, transA=1), g.add("Gemm", mixed, p, transA=1)
    return _made(g, dm, dw, g.add("ReduceSum", p, first, keepdims=0), g.add("ReduceSum", ds, first, keepdims=0), de)


@functools.cache
def class_logs(width: int, lead: int, steepest: float, most: float):
    """x (ids of windows), e (embeddings), em (times m), w, b, biases, kind (which bias a window has), y (classes that follow each
    place after the first lead, as a column) -> their log probabilities. None where onnxruntime can't run it."""
    g = _Graph(x="<i8", e="<f4", em="<f4", w="<f4", b="<f4", biases="<f4", kind="<i8", y="<i8")
    asking = g.add("Slice", "x", g.constant([lead], "<i8"), g.constant([1 << 31], "<i8"), g.constant([1], "<i8"))
    h = g.add("Gather", "e", "x")
    s = _scores(g, g.add("Gather", "em", asking), h, g.add("Gather", "biases", "kind"), steepest)
    logits = _logits(g, g.add("Reshape", g.add("MatMul", s, h), g.constant([-1, width], "<i8")), most)
    return _made(g, g.add("GatherElements", g.add("LogSoftmax", logits, axis=-1), "y", axis=1))


def _made(g: _Graph, *outputs: str):
    try:
        session = g.session(*outputs)
    except Exception:  # no onnxruntime, or one that doesn't know these operators: numpy does the sums
        return None
    return lambda **given: session.run(None, given)
