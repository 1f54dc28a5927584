"""Image and layout statistics (H13-H16, S11), numpy in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIZE = 64


def gaussian_blur(grey: np.ndarray, sigma: float) -> np.ndarray:
    """Separable, edges repeated."""
    r = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        padded = np.pad(grey, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        grey = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, padded)
    return grey


def dct_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II."""
    i = np.arange(n)
    m = np.cos(np.pi * (2 * i[None, :] + 1) * i[:, None] / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


#: Luminance weights; what channels of natural images correlate by, and the room above it; the clip limits.
LUMINANCE = (0.299, 0.587, 0.114)
NATURAL, ROOM = 0.85, 0.15
DARK, BRIGHT = 0.004, 0.996


def luminance(image: np.ndarray) -> np.ndarray:
    return image[..., :3] @ np.array(LUMINANCE) if image.ndim == 3 else image.astype(float)


def descriptor(image: np.ndarray) -> np.ndarray:
    """99 low-frequency coefficients of the luminance after its slow part and scale are gone."""
    grey = luminance(image)
    flat = grey - gaussian_blur(grey, 8.0)
    spread = flat.std()
    flat = flat / spread if spread > 1e-6 else flat
    rows, cols = dct_matrix(flat.shape[0]), dct_matrix(flat.shape[1])
    return (rows[:10] @ flat @ cols[:10].T).reshape(-1)[1:]


def laplacian(grey: np.ndarray) -> np.ndarray:
    """Four times each inner pixel less its four neighbours."""
    return -np.diff(grey[:, 1:-1], 2, axis=0) - np.diff(grey[1:-1, :], 2, axis=1)


def spectral_peaks(residual: np.ndarray) -> float:
    """Mean magnitude at the four quarter frequencies, over the mean of the medians of the 16 frequencies two and three
    steps around each; 0 for a residual without background."""
    h, w = residual.shape
    power, around = np.abs(np.fft.fft2(residual)), np.array([-3, -2, 2, 3])
    y, x = h // 4 * np.array([1, 1, 0, 1]), w // 4 * np.array([1, 0, 1, -1])
    ring = power[(y[:, None, None] + around[:, None]) % h, (x[:, None, None] + around) % w]
    background = np.median(ring.reshape(4, -1), axis=1).mean()
    return float(power[y % h, x % w].mean() / background) if background > 1e-9 else 0.0


def kurtosis(x: np.ndarray) -> float:
    """Excess, bias-corrected; 0 for constants."""
    x = x.ravel() - x.mean()
    n, v = x.size, np.mean(x**2)
    if v**0.5 < 1e-9:
        return 0.0
    return float((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (np.mean(x**4) / v**2 - 3) + 6))


def channel_anomaly(image: np.ndarray) -> float:
    """How far the mean absolute correlation of the channels lies above that of natural images; a constant channel
    correlates with none."""
    if image.ndim != 3 or image.shape[2] < 3:
        return 0.0
    channels = image[..., :3].reshape(-1, 3).T
    varied = channels.std(axis=1) >= 1e-9
    with np.errstate(invalid="ignore", divide="ignore"):
        found = np.where(np.outer(varied, varied), np.abs(np.corrcoef(channels)), 0.0)
    return float(max(0.0, found[np.triu_indices(3, 1)].mean() - NATURAL) / ROOM)


def artifacts(image: np.ndarray) -> dict[str, float]:
    """Statistics that image generators disturb."""
    residual = laplacian(luminance(image))
    return {
        "spectral_peak_ratio": spectral_peaks(residual), "residual_kurtosis": kurtosis(residual), "color_corr_anomaly": channel_anomaly(image), "saturation_clip_ratio": float(np.mean((image <= DARK) | (image >= BRIGHT))),
    }


def ink_grid(canvas: np.ndarray, rows: int = 16, cols: int = 10) -> np.ndarray:
    """Mean ink of each cell of a page."""
    y, x = np.linspace(0, canvas.shape[0], rows + 1).astype(int), np.linspace(0, canvas.shape[1], cols + 1).astype(int)
    return np.array([canvas[y[i] : y[i + 1], x[j] : x[j + 1]].mean() for i in range(rows) for j in range(cols)])


def face(identity: np.ndarray, rng: np.random.Generator, synthetic: bool = False, strength: float = 0.8, size: int = SIZE) -> np.ndarray:
    """A procedural portrait: identity sets a low-frequency texture; capture adds light, shift and noise; a generator
    adds an upsampling grid and clipped colours."""
    k = int(np.sqrt(len(identity)))
    coarse = identity[: k * k].reshape(k, k)
    full = np.zeros((size, size))
    full[:k, :k] = coarse * np.linspace(1.0, 0.4, k)[:, None]
    base = dct_matrix(size).T @ full @ dct_matrix(size)
    base = 0.5 + 0.18 * (base - base.mean()) / (base.std() + 1e-9)
    light = 1 + 0.05 * rng.normal() + 0.04 * rng.normal() * np.linspace(-1, 1, size)[:, None]
    image = np.repeat((base * light)[..., None], 3, 2) * np.array([1.0, 0.92, 0.86]) + rng.normal(0, 0.01, (size, size, 3))
    if synthetic:
        grid = np.indices((size, size)).sum(0) % 4 == 0
        image = image + strength * 0.03 * grid[..., None] + strength * 0.02 * rng.normal(size=(1, 1, 3))
    return np.clip(image, 0, 1)


def layout(template: int, rng: np.random.Generator, jitter: float = 0.004, shape: tuple[int, int] = (80, 128)) -> np.ndarray:
    """A page of ink boxes whose places the template fixes up to a jitter."""
    fixed, page = np.random.default_rng(template), np.zeros(shape)
    for _ in range(9):
        y, x, h, w = fixed.uniform(0, 0.8), fixed.uniform(0, 0.7), fixed.uniform(0.04, 0.2), fixed.uniform(0.1, 0.3)
        y, x = y + rng.normal(0, jitter), x + rng.normal(0, jitter)
        a, b = max(0, int(y * shape[0])), max(0, int(x * shape[1]))
        page[a : a + int(h * shape[0]) + 1, b : b + int(w * shape[1]) + 1] = fixed.uniform(0.4, 1)
    return np.clip(page + rng.normal(0, 0.01, shape), 0, 1)


def ppm(image: np.ndarray) -> bytes:
    """An image in [0, 1] as a binary PPM of eight bits."""
    body = (np.clip(image, 0, 1) * 255).round().astype(np.uint8)
    return f"P6\n{body.shape[1]} {body.shape[0]}\n255\n".encode() + body.tobytes()


def rendered(spark, n: int, seed: int = 0) -> DataFrame:
    """path, content of ``n`` procedural portraits, each from its own number."""

    def run(batches):
        for pdf in batches:
            made = [np.random.default_rng([seed, int(i)]) for i in pdf["id"]]
            yield pd.DataFrame({"path": [f"rendered/{i}.ppm" for i in pdf["id"]], "content": [ppm(face(rng.normal(size=64), rng)) for rng in made]})

    return spark.range(n).mapInPandas(run, "path string, content binary")


def image_corpus(spark, path: str | None, pattern: str = "*.ppm", fallback: int = 64, seed: int = 0) -> DataFrame:
    """Images as binary rows (path, content); where there is no folder, or none in it, procedural ones."""
    if path is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
            if not found.select("path").isEmpty():
                return found
    return rendered(spark, fallback, seed)


def parse_ppm(raw: bytes) -> np.ndarray:
    """Binary PPM (P6) as floats in [0, 1]."""
    kind, width, height, most, body = raw.split(maxsplit=4)[:4] + [raw[-int(raw.split(maxsplit=3)[1]) * int(raw.split(maxsplit=3)[2]) * 3 :]]
    if kind != b"P6":
        raise ValueError("not a binary PPM")
    return np.frombuffer(body, np.uint8).reshape(int(height), int(width), 3) / int(most)


def image_features(images: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, descriptor and artifact statistics of encoded images."""

    def run(batches):
        for pdf in batches:
            found = [parse_ppm(bytes(b)) for b in pdf[content]]
            stats = [artifacts(i) for i in found]
            yield pd.DataFrame({key: pdf[key], "descriptor": [descriptor(i).tolist() for i in found], **{k: [s[k] for s in stats] for k in ("spectral_peak_ratio", "residual_kurtosis", "color_corr_anomaly", "saturation_clip_ratio")}})

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, content).mapInPandas(run, f"{key} {kind}, descriptor array<double>, spectral_peak_ratio double, residual_kurtosis double, color_corr_anomaly double, saturation_clip_ratio double")
