"""Fixed values of the reports' meaning, together."""

WINDOW = 20
EARTH_KM, KNOTS_PER_KM_H = 6371.0088, 0.539956803
FREEZE_IMPLIED, FREEZE_VOTE, FREEZE_PAIRS = 0.5, 0.5, 3
MAX_GAP_S = 600
UNDERWAY_KNOTS = 1.0
HISTOGRAM = {"bins": 120, "low": 1e-5, "per_decade": 20}
A_RANGE, B_OVER_A = (1e-4, 10.0), 1.5
#: The error that flagged a report before thresholds were stored; a placeholder that nothing calibrated.
OPERATING_THRESHOLD = 0.004946
