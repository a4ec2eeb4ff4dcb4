"""Many windows in one call of a model, which a worker loads once."""

import numpy as np
import pytest

from peaklight.model import Denoise
from peaklight.operators import signal


def spectra(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in 5 + np.sin(np.arange(n) / 7) + 0.2 * rng.random(n)]) for i, n in enumerate([3000, 40, 2, 1300, 1301, 5000] * 4)]
    rows += [(100, None), (101, []), (102, [2.0] * 50), (103, [1.0])]
    return spark.createDataFrame(rows, "row_id long, intensity array<double>").repartition(3)


def test_batches_give_what_single_windows_give(spark, tmp_path):
    df, how, place = spectra(spark), Denoise(), str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{place}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(x):
            open(f"{place}/call-{len(x)}-{uuid.uuid4().hex}", "w").close()
            return np.clip(0.5 * x + 0.5 * np.roll(x, 1, axis=1), 0, 1)

        return model

    one = {r.row_id: r.denoised for r in signal.denoise(df, lambda x: np.clip(0.5 * x + 0.5 * np.roll(x, 1), 0, 1), how).collect()}
    many = {r.row_id: r.denoised for r in signal.denoise_in_batches(df, "roll", load, how, windows=16).collect()}
    assert one.keys() == many.keys() and all(np.allclose(one[k] or [], many[k] or [], atol=1e-12) for k in one)
    calls = [int(p.name.split("-")[1]) for p in tmp_path.glob("call-*")]
    windows = 4 * (3 + 1 + 1 + 1 + 1 + 5)
    assert sum(calls) == windows and max(calls) <= 16 and len(calls) <= windows // 16 + 3
    again = signal.denoise_in_batches(df, "roll", load, how).count()
    loads = [p.name.split("-")[1] for p in tmp_path.glob("load-*")]
    assert again == len(one) and len(loads) == len(set(loads)) <= 8  # each worker once


def test_a_model_must_give_as_many_numbers_as_it_takes(spark):
    with pytest.raises(Exception, match="the model cut gave"):
        signal.denoise_in_batches(spectra(spark), "cut", lambda: lambda x: x[:, :-1]).collect()


def test_nothing_to_do_loads_nothing(spark):
    def load():
        raise RuntimeError("loaded")

    df = spectra(spark)
    assert signal.denoise_in_batches(df.where("row_id >= 100"), "never", load).count() == 4 and signal.denoise_in_batches(df.where("false"), "never", load).count() == 0
