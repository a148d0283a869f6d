"""Fixed values of the control charts."""

from __future__ import annotations

# Control chart factors by subgroup size, 2 to 25.
# size: A2, D3, D4, d2
RANGE_FACTORS = {
    2: (1.880, 0.0, 3.267, 1.128),
    3: (1.023, 0.0, 2.574, 1.693),
    4: (0.729, 0.0, 2.282, 2.059),
    5: (0.577, 0.0, 2.114, 2.326),
    6: (0.483, 0.0, 2.004, 2.534),
    7: (0.419, 0.076, 1.924, 2.704),
    8: (0.373, 0.136, 1.864, 2.847),
    9: (0.337, 0.184, 1.816, 2.970),
    10: (0.308, 0.223, 1.777, 3.078),
    11: (0.285, 0.256, 1.744, 3.173),
    12: (0.266, 0.283, 1.717, 3.258),
    13: (0.249, 0.307, 1.693, 3.336),
    14: (0.235, 0.328, 1.672, 3.407),
    15: (0.223, 0.347, 1.653, 3.472),
    16: (0.212, 0.363, 1.637, 3.532),
    17: (0.203, 0.378, 1.622, 3.588),
    18: (0.194, 0.391, 1.608, 3.640),
    19: (0.187, 0.403, 1.597, 3.689),
    20: (0.180, 0.415, 1.585, 3.735),
    21: (0.173, 0.425, 1.575, 3.778),
    22: (0.167, 0.434, 1.566, 3.819),
    23: (0.162, 0.443, 1.557, 3.858),
    24: (0.157, 0.451, 1.548, 3.895),
    25: (0.153, 0.459, 1.541, 3.931),
}
# size: A3, B3, B4, c4
DEVIATION_FACTORS = {
    2: (2.659, 0.0, 3.267, 0.7979),
    3: (1.954, 0.0, 2.568, 0.8862),
    4: (1.628, 0.0, 2.266, 0.9213),
    5: (1.427, 0.0, 2.089, 0.9400),
    6: (1.287, 0.030, 1.970, 0.9515),
    7: (1.182, 0.118, 1.882, 0.9594),
    8: (1.099, 0.185, 1.815, 0.9650),
    9: (1.032, 0.239, 1.761, 0.9693),
    10: (0.975, 0.284, 1.716, 0.9727),
    11: (0.927, 0.321, 1.679, 0.9754),
    12: (0.886, 0.354, 1.646, 0.9776),
    13: (0.850, 0.382, 1.618, 0.9794),
    14: (0.817, 0.406, 1.594, 0.9810),
    15: (0.789, 0.428, 1.572, 0.9823),
    16: (0.763, 0.448, 1.552, 0.9835),
    17: (0.739, 0.466, 1.534, 0.9845),
    18: (0.718, 0.482, 1.518, 0.9854),
    19: (0.698, 0.497, 1.503, 0.9862),
    20: (0.680, 0.510, 1.490, 0.9869),
    21: (0.663, 0.523, 1.477, 0.9876),
    22: (0.647, 0.534, 1.466, 0.9882),
    23: (0.633, 0.545, 1.455, 0.9887),
    24: (0.619, 0.555, 1.445, 0.9892),
    25: (0.606, 0.565, 1.435, 0.9896),
}
DEFAULT_RANGE_SIZE = 5
DEFAULT_DEVIATION_SIZE = 10

# Individuals chart (moving range of two points), minimum history, limit tightening.
D2_PAIR = 1.128
E2_PAIR = 2.660
D4_PAIR = 3.267
MIN_GROUPS = 25
MIN_POINTS = 100
TIGHTEN = 0.9
TIGHTEN_UPPER_NO_CENTRE = 0.9
TIGHTEN_LOWER_NO_CENTRE = 1.1

# Capability grades, best first.
CAPABILITY_GRADES = ((1.67, "A+"), (1.33, "A"), (1.0, "B"), (0.67, "C"))
LOWEST_GRADE = "D"

# Source labels of the characteristic type.
CHARACTERISTIC_LABELS = {"药水": "chemical", "产品": "product", "流程": "process"}
RULES_PRODUCT = "R0R1R2R3"
RULES_OTHER = "R0R1"

# Fixed value: day key of a row without a business date.
INVALID_DAY = "99999999"
