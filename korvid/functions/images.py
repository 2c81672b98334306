"""Image embeddings by an ONNX model; the model is a parameter, none is shipped."""

from __future__ import annotations

import numpy as np


def read_pnm(content: bytes) -> np.ndarray:
    """(height, width, 3) of a binary PGM or PPM file."""
    fields, at = [], 0
    while len(fields) < 4:
        end = at
        while content[end : end + 1].strip():
            end += 1
        if end > at:
            fields.append(content[at:end])
        at = end + 1
    kind, width, height = fields[0], int(fields[1]), int(fields[2])
    if kind not in (b"P5", b"P6") or int(fields[3]) > 255:
        raise ValueError("only 8-bit binary PGM and PPM files are read")
    pixels = np.frombuffer(content, np.uint8, offset=at).reshape(height, width, 1 if kind == b"P5" else 3)
    return np.broadcast_to(pixels, (height, width, 3))


def resized(image: np.ndarray, side: int) -> np.ndarray:
    y = np.minimum((np.arange(side) + 0.5) * image.shape[0] / side, image.shape[0] - 1).astype(int)
    x = np.minimum((np.arange(side) + 0.5) * image.shape[1] / side, image.shape[1] - 1).astype(int)
    return image[y][:, x]


def onnx_extractor(model: str, side: int = 224, decode=read_pnm):
    """An extractor for IMAGE columns: the model's output to unit length. Sessions live as long as the worker."""
    mean, deviation = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])
    held: dict = {}

    def extract(path: str) -> list[float]:
        import onnxruntime

        if "session" not in held:
            held["session"] = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        session = held["session"]
        with open(path, "rb") as f:
            image = (resized(decode(f.read()), side) / 255 - mean) / deviation
        batch = image.transpose(2, 0, 1)[None].astype(np.float32)
        out = np.asarray(session.run(None, {session.get_inputs()[0].name: batch})[0], float).reshape(-1)
        size = np.linalg.norm(out)
        return (out / size if size else out).tolist()

    return extract
