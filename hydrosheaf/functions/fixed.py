"""Fixed values of the design guides: critical values, class probabilities, zone tables."""

# fixed values: Dixon critical values by series length, per significance level
DIXON = {
    0.05: [(3, 0.970), (4, 0.829), (5, 0.710), (6, 0.628), (7, 0.569), (8, 0.523), (10, 0.455), (12, 0.408),
           (15, 0.364), (20, 0.310), (25, 0.275), (30, 0.250), (40, 0.220), (50, 0.200), (70, 0.175), (90, 0.155)],
    0.01: [(3, 0.994), (4, 0.926), (5, 0.821), (6, 0.740), (7, 0.680), (8, 0.634), (10, 0.568), (12, 0.521),
           (15, 0.470), (20, 0.406), (25, 0.363), (30, 0.330), (40, 0.290), (50, 0.265), (70, 0.235), (90, 0.210)],
    0.10: [(3, 0.941), (4, 0.765), (5, 0.642), (6, 0.560), (7, 0.507), (8, 0.468), (10, 0.412), (12, 0.371),
           (15, 0.330), (20, 0.280), (25, 0.250), (30, 0.228), (40, 0.200), (50, 0.180), (70, 0.158), (90, 0.140)],
}
DIXON_FACTOR = {"D1N": 1.0, "D2N": 1.05, "D3N": 1.05, "D4N": 1.10, "D5N": 1.15}

# fixed values: Dixon critical values by length and skewness class (Cs < 0.5, < 1.5, larger)
_CS_N = (3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 25, 30)
DIXON_BY_SKEW = {
    (0.05, "low"): (0.970, 0.829, 0.710, 0.628, 0.569, 0.523, 0.455, 0.414, 0.364, 0.300, 0.268, 0.245),
    (0.05, "med"): (0.965, 0.815, 0.695, 0.610, 0.555, 0.508, 0.440, 0.398, 0.350, 0.285, 0.252, 0.230),
    (0.05, "high"): (0.955, 0.790, 0.670, 0.585, 0.530, 0.485, 0.415, 0.375, 0.325, 0.260, 0.228, 0.205),
    (0.01, "low"): (0.994, 0.926, 0.821, 0.740, 0.680, 0.634, 0.568, 0.521, 0.470, 0.391, 0.351, 0.321),
    (0.01, "med"): (0.991, 0.910, 0.805, 0.720, 0.660, 0.615, 0.550, 0.505, 0.455, 0.375, 0.335, 0.305),
    (0.01, "high"): (0.985, 0.885, 0.780, 0.695, 0.635, 0.590, 0.520, 0.475, 0.425, 0.345, 0.305, 0.275),
}
DIXON_BY_SKEW = {k: list(zip(_CS_N, v)) for k, v in DIXON_BY_SKEW.items()}
DIXON_LONG = {0.05: 0.18, 0.01: 0.24}  # beyond n = 30

# fixed values: Grubbs critical values by series length
_G_N = (3, 5, 7, 10, 15, 20, 25, 30)
GRUBBS_MAX = {
    0.01: list(zip(_G_N, (1.155, 1.672, 1.939, 2.234, 2.528, 2.740, 2.896, 3.022))),
    0.05: list(zip(_G_N, (1.155, 1.672, 1.939, 2.176, 2.409, 2.557, 2.663, 2.745))),
    0.10: list(zip(_G_N, (1.155, 1.672, 1.939, 2.086, 2.289, 2.409, 2.492, 2.553))),
}
GRUBBS_GAP = {
    0.01: list(zip(_G_N, (0.000, 0.659, 0.844, 1.025, 1.233, 1.368, 1.463, 1.534))),
    0.05: list(zip(_G_N, (0.000, 0.536, 0.714, 0.883, 1.076, 1.199, 1.286, 1.350))),
    0.10: list(zip(_G_N, (0.000, 0.447, 0.614, 0.775, 0.956, 1.068, 1.146, 1.201))),
}
# fixed values: stepwise Grubbs values for n up to 10, 15, 20, 30 and beyond
GRUBBS_STEP = {
    0.01: (2.41, 2.65, 2.80, 3.03, 3.24),
    0.05: (2.03, 2.21, 2.32, 2.48, 2.62),
    0.10: (1.76, 1.91, 1.99, 2.11, 2.18),
}

# fixed values: critical correlation by number of common years
RO_CRITICAL = [
    (5, 0.878), (6, 0.811), (7, 0.754), (8, 0.707), (9, 0.666), (10, 0.632), (11, 0.602), (12, 0.576),
    (13, 0.553), (14, 0.532), (15, 0.514), (16, 0.497), (17, 0.482), (18, 0.468), (19, 0.456), (20, 0.444),
    (25, 0.396), (30, 0.361), (35, 0.335), (40, 0.314), (50, 0.282), (60, 0.259), (80, 0.226), (100, 0.203),
    (150, 0.166), (200, 0.143),
]

# fixed values: exceedance probabilities of structure classes, (max main, max check, min main, min check)
STRUCTURE_P = {
    "I": (0.001, 0.0001, 0.95, 0.97),
    "II": (0.003, 0.001, 0.95, 0.97),
    "III": (0.01, 0.003, 0.90, 0.95),
    "IV": (0.03, 0.01, 0.80, 0.90),
}
# fixed values: lower bounds of dam height (m) and volume (million m3) per class
CLASS_HEIGHT = (("I", 100.0), ("II", 50.0), ("III", 15.0))
CLASS_VOLUME = (("I", 1000.0), ("II", 100.0), ("III", 10.0))
# fixed values: standard exceedance probabilities of the curves
P_CURVE = (0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99)
P_LEVELS = (0.01, 0.03, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
P_STRUCTURE = (0.01, 0.03, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99)
P_KM = (0.1, 1, 3, 5, 10, 25, 50, 75, 90, 95, 97, 99, 99.9)  # percent
P_MAX = (0.1, 0.33, 1.0, 2.0, 3.0, 5.0, 10.0, 20.0, 33.0, 50.0)  # percent
P_MIN = (80, 90, 95, 97, 99, 99.5, 99.9)  # percent
P_SEASON = (75, 80, 90, 95, 97, 99)  # percent
P_INDEX = (0.1, 1.0, 3.0, 5.0, 10.0, 20.0, 33.0, 50.0)  # percent
P_BANDS = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999)
P_COMPOSITE = (0.001, 0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99, 0.999)
P_TWO_PART = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999)
P_ORDINATES = (0.001, 0.01, 0.03, 0.05, 0.1, 0.3, 0.5, 1, 3, 5, 10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90, 95, 97, 99, 99.5, 99.7, 99.9)

# fixed values: month groups of the intra-annual distribution
NON_LIMITING = (4, 5, 6, 7, 8, 9, 10)
LIMITING = (11, 12, 1, 2, 3)
LIMITING_SEASON = (12, 1, 2)
SEASON_MONTHS = {"winter": (11, 12, 1, 2, 3), "summer": (6, 7, 8)}

# fixed values: flow duration probabilities
P_DURATION = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
DURATION_PERCENTILES = (5, 10, 25, 50, 75, 90, 95)

# fixed values: upper ratio Q / Q_mean of the flow classes (each doubled when compared)
ECO_RATIO = (("I", 0.05), ("II", 0.10), ("III", 0.20), ("IV", 0.30), ("V", 0.50), ("VI", 0.80))

# fixed values: seasonal ecological flow, monthly alpha and beta per region
SEASONAL_FLOW = {
    "northern": ((0.05, 0.05, 0.15, 0.50, 0.80, 0.50, 0.25, 0.15, 0.10, 0.05, 0.05, 0.05),
                 (0.5, 0.5, 0.6, 0.7, 0.8, 0.7, 0.6, 0.5, 0.5, 0.5, 0.5, 0.5)),
    "central": ((0.10, 0.10, 0.20, 0.60, 0.90, 0.60, 0.30, 0.20, 0.15, 0.10, 0.10, 0.10),
                (0.5, 0.5, 0.6, 0.7, 0.85, 0.7, 0.6, 0.5, 0.5, 0.5, 0.5, 0.5)),
    "southern": ((0.15, 0.12, 0.10, 0.30, 0.50, 0.80, 0.60, 0.40, 0.30, 0.20, 0.15, 0.15),
                 (0.5, 0.5, 0.5, 0.6, 0.7, 0.8, 0.7, 0.6, 0.6, 0.5, 0.5, 0.5)),
    "mountain": ((0.10, 0.10, 0.15, 0.40, 0.70, 0.90, 0.80, 0.60, 0.30, 0.15, 0.10, 0.10),
                 (0.5, 0.5, 0.6, 0.7, 0.8, 0.9, 0.85, 0.7, 0.6, 0.5, 0.5, 0.5)),
}

# fixed values: melt factor (mm per day and degree) and snow density (kg/m3) per zone 1..9
MELT_ZONE = ((2.5, 250), (3.0, 280), (3.5, 300), (4.0, 320), (3.5, 300), (3.0, 280), (2.8, 270), (3.2, 290), (2.0, 260))

# fixed values: rainfall intensity A T^m / (t + B)^n, zones 1..9 as (A, B, n, m)
IDF_ZONE = (
    (0.025, 5.0, 0.70, 0.10), (0.040, 8.0, 0.75, 0.12), (0.050, 10.0, 0.78, 0.13), (0.065, 12.0, 0.80, 0.15), (0.080, 15.0, 0.82, 0.17),
    (0.100, 18.0, 0.85, 0.18), (0.035, 6.0, 0.72, 0.11), (0.060, 10.0, 0.76, 0.14), (0.055, 8.0, 0.74, 0.16),
)
IDF_DURATIONS = (5, 10, 15, 30, 60, 90, 120, 180, 360, 720, 1440)  # minutes
RATIONAL_F_MAX = (50, 50, 50, 80, 100, 100, 50, 75, 50)  # km2, zones 1..9
# fixed values: runoff coefficients by surface and by zone 1..9
SURFACE_ALPHA = {
    "dense_urban": 0.70, "residential": 0.50, "park": 0.25, "farmland_clay": 0.40, "farmland_sand": 0.20, "forest_clay": 0.30,
    "forest_sand": 0.15, "grassland_clay": 0.35, "grassland_sand": 0.15, "marsh": 0.10, "rock": 0.75, "asphalt": 0.90, "roof": 0.95,
}
ZONE_ALPHA = (0.45, 0.35, 0.30, 0.25, 0.35, 0.45, 0.40, 0.40, 0.20)
# fixed values: regional regressions A F^n as (mean A, n, Q2 A, n, Q10 A, n, Q100 A, n, winter minimum A, n)
REGION = {
    "central_russia": (0.0025, 0.85, 0.08, 0.65, 0.12, 0.62, 0.18, 0.58, 0.0003, 0.90),
    "volga_basin": (0.0020, 0.88, 0.065, 0.68, 0.10, 0.64, 0.15, 0.60, 0.00025, 0.92),
    "ob_irtysh": (0.0030, 0.82, 0.09, 0.63, 0.13, 0.60, 0.20, 0.56, 0.00035, 0.88),
    "yenisei": (0.0035, 0.80, 0.10, 0.60, 0.15, 0.57, 0.22, 0.53, 0.0004, 0.85),
    "lena": (0.0032, 0.81, 0.095, 0.61, 0.14, 0.58, 0.21, 0.54, 0.00038, 0.86),
    "kama": (0.0022, 0.87, 0.07, 0.66, 0.105, 0.63, 0.16, 0.59, 0.00028, 0.91),
    "don": (0.0015, 0.90, 0.055, 0.70, 0.085, 0.66, 0.13, 0.62, 0.00015, 0.95),
    "neva": (0.0028, 0.84, 0.075, 0.67, 0.11, 0.63, 0.17, 0.59, 0.0003, 0.89),
    "caucasus": (0.0045, 0.75, 0.15, 0.55, 0.22, 0.50, 0.32, 0.45, 0.0005, 0.80),
}
# fixed values: weir coefficients, erosion factors
WEIR_CD = {"sharp_crested": 1.84, "broad_crested": 1.50, "ogee": 2.20}
EROSION = {"weak": 0.05, "moderate": 0.15, "strong": 0.40}
# fixed values: ice zones as (thickness range m, freeze period days, typical rise m, coefficient, snow correction, A)
ICE_ZONE = {
    "arctic": (1.5, 3.0, 200, 260, 1.5, 3.0, 1.0, 0.8, 0.45), "subarctic": (1.0, 2.0, 180, 230, 1.0, 2.5, 0.85, 0.85, 0.40),
    "cold_humid": (0.8, 1.5, 160, 200, 0.8, 2.0, 0.70, 0.90, 0.36), "moderate": (0.5, 1.2, 120, 180, 0.5, 1.5, 0.55, 1.0, 0.32),
    "dry": (0.3, 0.8, 90, 150, 0.3, 1.0, 0.40, 1.10, 0.28), "semi_arid": (0.2, 0.5, 60, 120, 0.2, 0.8, 0.30, 1.20, 0.22),
}
JAM_PROBABILITY = [(20, 0.85), (50, 0.65), (100, 0.45), (150, 0.30), (200, 0.20), (300, 0.10), (500, 0.05)]  # by channel width
JAM_KP = [(2, 0.9), (5, 0.8), (10, 0.7), (25, 0.6), (50, 0.5), (100, 0.4), (500, 0.3)]  # by return period
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
