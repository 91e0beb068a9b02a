"""Radio waves in air: refractivity and specific attenuation."""

from __future__ import annotations

from isobath.functions.algebra import exp, sqrt

EARTH_RADIUS_M = 6.371e6
# Rec. ITU-R P.676 Annex 1, Table 1, all 44 oxygen lines: f0 (GHz), a1, a2, a3, a5, a6 (a4 is 0).
OXYGEN_LINES = (
    (50.474214, 0.975, 9.651, 6.69, 2.566, 6.85), (50.987745, 2.529, 8.653, 7.17, 2.246, 6.8), (51.50336, 6.193, 7.709, 7.64, 1.947, 6.729), (52.021429, 14.32, 6.819, 8.11, 1.667, 6.64),
    (52.542418, 31.24, 5.983, 8.58, 1.388, 6.526), (53.066934, 64.29, 5.201, 9.06, 1.349, 6.206), (53.595775, 124.6, 4.474, 9.55, 2.227, 5.085), (54.130025, 227.3, 3.8, 9.96, 3.17, 3.75),
    (54.67118, 389.7, 3.182, 10.37, 3.558, 2.654), (55.221384, 627.1, 2.618, 10.89, 2.56, 2.952), (55.783815, 945.3, 2.109, 11.34, -1.172, 6.135), (56.264774, 543.4, 0.014, 17.03, 3.525, -0.978),
    (56.363399, 1331.8, 1.654, 11.89, -2.378, 6.547), (56.968211, 1746.6, 1.255, 12.23, -3.545, 6.451), (57.612486, 2120.1, 0.91, 12.62, -5.416, 6.056), (58.323877, 2363.7, 0.621, 12.95, -1.932, 0.436),
    (58.446588, 1442.1, 0.083, 14.91, 6.768, -1.273), (59.164204, 2379.9, 0.387, 13.53, -6.561, 2.309), (59.590983, 2090.7, 0.207, 14.08, 6.957, -0.776), (60.306056, 2103.4, 0.207, 14.15, -6.395, 0.699),
    (60.434778, 2438.0, 0.386, 13.39, 6.342, -2.825), (61.150562, 2479.5, 0.621, 12.92, 1.014, -0.584), (61.800158, 2275.9, 0.91, 12.63, 5.014, -6.619), (62.41122, 1915.4, 1.255, 12.17, 3.029, -6.759),
    (62.486253, 1503.0, 0.083, 15.13, -4.499, 0.844), (62.997984, 1490.2, 1.654, 11.74, 1.856, -6.675), (63.568526, 1078.0, 2.108, 11.34, 0.658, -6.139), (64.127675, 728.7, 2.617, 10.88, -3.036, -2.895),
    (64.67891, 461.3, 3.181, 10.38, -3.968, -2.59), (65.224078, 274.0, 3.8, 9.96, -3.528, -3.68), (65.764779, 153.0, 4.473, 9.55, -2.548, -5.002), (66.302096, 80.4, 5.2, 9.06, -1.66, -6.091),
    (66.836834, 39.8, 5.982, 8.58, -1.68, -6.393), (67.369601, 18.56, 6.818, 8.11, -1.956, -6.475), (67.900868, 8.172, 7.708, 7.64, -2.216, -6.545), (68.431006, 3.397, 8.652, 7.17, -2.492, -6.6),
    (68.960312, 1.334, 9.65, 6.69, -2.773, -6.65), (118.750334, 940.3, 0.01, 16.64, -0.439, 0.079), (368.498246, 67.4, 0.048, 16.4, 0.0, 0.0), (424.76302, 637.7, 0.044, 16.4, 0.0, 0.0),
    (487.249273, 237.4, 0.049, 16.0, 0.0, 0.0), (715.392902, 98.1, 0.145, 16.0, 0.0, 0.0), (773.83949, 572.3, 0.141, 16.2, 0.0, 0.0), (834.145546, 183.1, 0.145, 14.7, 0.0, 0.0),
)
# Rec. ITU-R P.676 Annex 1, Table 2, all 34 water-vapour lines: f0 (GHz), b1 .. b6.
VAPOUR_LINES = (
    (22.23508, 0.1079, 2.144, 26.38, 0.76, 5.087, 1.0), (67.80396, 0.0011, 8.732, 28.58, 0.69, 4.93, 0.82), (119.99594, 0.0007, 8.353, 29.48, 0.7, 4.78, 0.79),
    (183.310087, 2.273, 0.668, 29.06, 0.77, 5.022, 0.85), (321.22563, 0.047, 6.179, 24.04, 0.67, 4.398, 0.54), (325.152888, 1.514, 1.541, 28.23, 0.64, 4.893, 0.74),
    (336.227764, 0.001, 9.825, 26.93, 0.69, 4.74, 0.61), (380.197353, 11.67, 1.048, 28.11, 0.54, 5.063, 0.89), (390.134508, 0.0045, 7.347, 21.52, 0.63, 4.81, 0.55),
    (437.346667, 0.0632, 5.048, 18.45, 0.6, 4.23, 0.48), (439.150807, 0.9098, 3.595, 20.07, 0.63, 4.483, 0.52), (443.018343, 0.192, 5.048, 15.55, 0.6, 5.083, 0.5),
    (448.001085, 10.41, 1.405, 25.64, 0.66, 5.028, 0.67), (470.888999, 0.3254, 3.597, 21.34, 0.66, 4.506, 0.65), (474.689092, 1.26, 2.379, 23.2, 0.65, 4.804, 0.64),
    (488.490108, 0.2529, 2.852, 25.86, 0.69, 5.201, 0.72), (503.568532, 0.0372, 6.731, 16.12, 0.61, 3.98, 0.43), (504.482692, 0.0124, 6.731, 16.12, 0.61, 4.01, 0.45),
    (547.67644, 0.9785, 0.158, 26.0, 0.7, 4.5, 1.0), (552.02096, 0.184, 0.158, 26.0, 0.7, 4.5, 1.0), (556.935985, 497.0, 0.159, 30.86, 0.69, 4.552, 1.0),
    (620.700807, 5.015, 2.391, 24.38, 0.71, 4.856, 0.68), (645.766085, 0.0067, 8.633, 18.0, 0.6, 4.0, 0.5), (658.00528, 0.2732, 7.816, 32.1, 0.69, 4.14, 1.0),
    (752.033113, 243.4, 0.396, 30.86, 0.68, 4.352, 0.84), (841.051732, 0.0134, 8.177, 15.9, 0.33, 5.76, 0.45), (859.965698, 0.1325, 8.055, 30.6, 0.68, 4.09, 0.84),
    (899.303175, 0.0547, 7.914, 29.85, 0.68, 4.53, 0.9), (902.611085, 0.0386, 8.429, 28.65, 0.7, 5.1, 0.95), (906.205957, 0.1836, 5.11, 24.08, 0.7, 4.7, 0.53),
    (916.171582, 8.4, 1.441, 26.73, 0.7, 5.15, 0.78), (923.113555, 0.0079, 10.293, 29.0, 0.7, 5.0, 0.8), (970.315022, 9.009, 1.919, 25.5, 0.64, 4.94, 0.67),
    (987.926764, 134.6, 0.257, 29.85, 0.68, 4.55, 0.9),
)
# Rec. ITU-R P.838-3 rain coefficients: f (GHz), k and alpha for horizontal, k and alpha for vertical polarisation.
RAIN = (
    (1.0, 0.0000387, 0.9120, 0.0000352, 0.8800), (2.0, 0.0002000, 0.9630, 0.0001380, 0.9230), (4.0, 0.0006500, 1.1210, 0.0005910, 1.0750), (6.0, 0.0017500, 1.3080, 0.0015500, 1.2650),
    (8.0, 0.0045000, 1.3270, 0.0039500, 1.3100), (10.0, 0.0121700, 1.2571, 0.0112900, 1.2156), (12.0, 0.0218600, 1.2000, 0.0202800, 1.1825), (15.0, 0.0367000, 1.1540, 0.0335000, 1.1280),
    (20.0, 0.0751000, 1.0990, 0.0691000, 1.0651), (25.0, 0.1240000, 1.0610, 0.1130000, 1.0300), (30.0, 0.1870000, 1.0210, 0.1670000, 1.0000), (40.0, 0.3500000, 0.9390, 0.3100000, 0.9290),
    (50.0, 0.5360000, 0.8730, 0.4790000, 0.8680), (60.0, 0.7070000, 0.8260, 0.6420000, 0.8240), (70.0, 0.8510000, 0.7930, 0.7840000, 0.7930), (80.0, 0.9750000, 0.7690, 0.9060000, 0.7690),
    (90.0, 1.0600000, 0.7530, 0.9990000, 0.7540), (100.0, 1.1200000, 0.7430, 1.0600000, 0.7440),
)


def refractivity(p_hpa, t_k, e_hpa):
    """N of moist air, Rec. ITU-R P.453."""
    return 77.6 / t_k * (p_hpa + 4810.0 * e_hpa / t_k)


def saturation_pressure(t_c):
    """Water-vapour pressure (hPa) at saturation over water."""
    return 6.1121 * exp(17.502 * t_c / (t_c + 240.97))


def vapour_pressure(humidity, t_c):
    return humidity * saturation_pressure(t_c)


def modified_refractivity(n, height_m):
    return n + height_m * (1.0e6 / EARTH_RADIUS_M)


def standard_refractivity(height_m, n0=315.0, scale_m=8077.0):
    return n0 * exp(-height_m / scale_m)


def refractive_index(m):
    return 1.0 + m * 1.0e-6


def _both_sides(f, f0, width, shift=0.0):
    """Van Vleck-Weisskopf shape of a line with an interference term."""
    near, far = f0 - f, f0 + f
    return f / f0 * ((width - shift * near) / (near * near + width * width) + (width - shift * far) / (far * far + width * width))


def oxygen_line(f, p, e, theta, line):
    """A line's share of N''; line is (f0, a1, a2, a3, a5, a6)."""
    from isobath.functions.algebra import power

    f0, a1, a2, a3, a5, a6 = line
    t08 = power(theta, 0.8)
    raw = 1e-4 * a3 * (p * t08 + 1.1 * e * theta)
    strength = 1e-7 * a1 * p * theta * theta * theta * exp(a2 * (1.0 - theta))
    return strength * _both_sides(f, f0, sqrt(raw * raw + 2.25e-6), 1e-4 * (a5 + a6 * theta) * (p + e) * t08)


def dry_continuum(f, p, e, theta):
    """Debye spectrum of oxygen and pressure-induced nitrogen."""
    from isobath.functions.algebra import power

    d = 5.6e-4 * (p + e) * power(theta, 0.8)
    debye = 6.14e-5 / (d * (1.0 + f / d * (f / d)))
    nitrogen = 1.4e-12 * p * theta * sqrt(theta) / (1.0 + 1.9e-5 * f * sqrt(f))
    return f * p * theta * theta * (debye + nitrogen)


def vapour_line(f, p, e, theta, line):
    """A line's share of N''; line is (f0, b1, .., b6)."""
    from isobath.functions.algebra import power

    f0, b1, b2, b3, b4, b5, b6 = line
    raw = 1e-4 * b3 * (p * power(theta, b4) + b5 * e * power(theta, b6))
    width = 0.535 * raw + sqrt(0.217 * raw * raw + 2.1316e-12 * f0 * f0 / theta)
    strength = 0.1 * b1 * e * theta * theta * theta * sqrt(theta) * exp(b2 * (1.0 - theta))
    return strength * _both_sides(f, f0, width)


def specific(f, npp):
    """dB/km of an imaginary refractivity."""
    return 0.1820 * f * npp


def rain(k, alpha, rate_mm_h):
    from isobath.functions.algebra import power

    return k * power(rate_mm_h, alpha)
