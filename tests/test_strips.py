"""Strips are as long as the events, not as the given tables."""

import datetime

import numpy as np

from motiontables.plans import signals


def test_strips_span_all_days(spark, tmp_path):
    deal, first = np.random.default_rng(3), datetime.datetime(2023, 12, 28, 5)
    counts = deal.integers(0, 6, (3, 47))
    counts[0, 0] = counts[1, -1] = 2
    rows = [(u, first + datetime.timedelta(days=d, seconds=i)) for u in range(3) for d in range(47) for i in range(counts[u, d])]
    spark.createDataFrame(rows, "user_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    day = np.arange(47)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * day / 46)
    got = [{r.clip_id: r for r in f(spark, str(tmp_path)).collect()} for f in (signals.profile_detrend, signals.periodogram_peak, signals.lag_correlation)]
    for u in range(3):
        signal = counts[u] - np.polyval(np.polyfit(day, counts[u], 1), day)
        assert got[0][u].samples == 47
        assert np.isclose(got[0][u].contrast, np.quantile(signal, 0.95) - np.quantile(signal, 0.05), atol=1e-7)
        assert got[1][u].peak == 1 + np.argmax(np.abs(np.fft.rfft(signal * hann))[1:24])
        assert np.isclose(got[2][u].lag_correlation, np.corrcoef(signal[:-7], signal[7:])[0, 1], atol=1e-6)


def test_given_events_span_thirty_days(spark):
    assert {r.samples for r in signals.profile_detrend(spark, "/root/testdata/sf0.001").select("samples").distinct().collect()} == {30}
