"""Policies that come with the engine: calibrators of word probabilities and thresholds for 2 % errors among accepted words.

Their scores are word probabilities of a large decoder, on read English speech with white noise at each level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Condition, pairs of the fit, target risk, threshold, coverage, realised risk, and the knots (x; y).
POLICIES = (
    (
        "clean", 1157, 0.02, 0.7646788452511345, 0.9040622299049266, 0.019120458891013385,
        (0.205, 0.615, 0.68, 0.846, 0.881, 0.974, 0.99, 0.993, 0.994, 1.0),
        (0.16666666666666666, 0.7, 0.7272727272727273, 0.7678571428571429, 0.8666666666666667, 0.9285714285714286, 0.950354609929078, 0.948051948051948, 0.9310344827586207, 0.9985272459499264),
    ),
    (
        "20", 1166, 0.02, 0.7889515658432212, 0.8679245283018868, 0.019762845849802372,
        (0.222, 0.687, 0.757, 0.816, 0.913, 0.924, 0.953, 0.991, 0.995, 0.997, 0.999, 1.0),
        (0.2222222222222222, 0.6333333333333333, 0.64, 0.6666666666666666, 0.8113207547169812, 0.8461538461538461, 0.9142857142857143, 0.9559471365638766, 0.9805194805194806, 0.9833333333333333, 0.9883268482490273, 0.9953051643192489),
    ),
    (
        "10", 1158, 0.02, 0.8829787234042552, 0.7780656303972366, 0.01997780244173141,
        (0.173, 0.26, 0.761, 0.786, 0.845, 0.857, 0.908, 0.925, 0.972, 0.981, 0.985, 0.996, 1.0, 1.0),
        (0.14285714285714285, 0.4, 0.5842696629213482, 0.7272727272727273, 0.8, 0.8181818181818182, 0.8780487804878049, 0.8636363636363636, 0.9285714285714286, 0.9594594594594594, 0.9574468085106383, 0.9798488664987406, 0.9878419452887538, 0.8333333333333334),
    ),
    (
        "5", 1162, 0.02, 0.9305929919137467, 0.5688468158347676, 0.019667170953101363,
        (0.125, 0.146, 0.495, 0.67, 0.821, 0.842, 0.881, 0.952, 0.957, 0.96, 0.988, 0.992, 0.997, 0.999, 1.0),
        (0.14285714285714285, 0.5, 0.5111111111111111, 0.6470588235294118, 0.6976744186046511, 0.7058823529411765, 0.75, 0.8256880733944955, 0.8571428571428571, 0.875, 0.9528301886792453, 0.9607843137254902, 0.9858657243816255, 0.987012987012987, 0.967741935483871),
    ),
    (
        "0", 1186, 0.02, 1.1, 0.0, 0.0,
        (0.073, 0.115, 0.22, 0.324, 0.617, 0.662, 0.721, 0.742, 0.766, 0.886, 0.914, 0.937, 0.954, 0.957, 0.969, 0.974, 0.986, 0.991, 0.998, 0.999, 1.0),
        (0.125, 0.25, 0.25925925925925924, 0.2826086956521739, 0.4550898203592814, 0.47058823529411764, 0.5306122448979592, 0.5333333333333333, 0.6333333333333333, 0.68, 0.7619047619047619, 0.7674418604651163, 0.7857142857142857, 0.7142857142857143, 0.896551724137931, 0.8846153846153846, 0.9230769230769231, 0.9393939393939394, 0.9679144385026738, 0.9661016949152542, 0.8888888888888888),
    ),
    (
        "-5", 1258, 0.02, 1.1, 0.0, 0.0,
        (0.036, 0.136, 0.469, 0.496, 0.671, 0.759, 0.794, 0.818, 0.844, 0.857, 0.877, 0.887, 0.921, 0.967, 0.973, 0.981, 0.993, 0.993, 0.999, 0.999),
        (0.25, 0.11594202898550725, 0.20294117647058832, 0.32142857142857145, 0.315, 0.37894736842105264, 0.40540540540540543, 0.42857142857142855, 0.43243243243243246, 0.52, 0.53125, 0.5833333333333334, 0.6415094339622641, 0.7115384615384616, 0.7096774193548387, 0.78125, 0.8170731707317073, 0.75, 0.8412698412698413, 0.75),
    ),
)


def policies(spark: SparkSession) -> DataFrame:
    """The policies in the form that sources.policies.load() gives."""
    rows = [
        (condition, n_fit, [{"x": x, "y": y} for x, y in zip(xs, ys, strict=True)], threshold, risk, coverage, realized, "comes with the engine")
        for condition, n_fit, risk, threshold, coverage, realized, xs, ys in POLICIES
    ]
    return spark.createDataFrame(rows, "condition string, n_fit long, knots array<struct<x:double,y:double>>, threshold double, target_risk double, coverage double, realized_risk double, notes string")
