"""Published evaluation results of the original pipeline (fixed values).

The 62-row threshold curve, recovered as integer (tp, fp) per threshold from
the published (threshold, F1, net value) triples with 432 positives, 1,568
negatives and mean CLV 4010.794546.  Columns: threshold, tp, fp, F1, net.
"""

POSITIVES = 432
NEGATIVES = 1568
MEAN_CLV = 4010.794546

CURVE = [
    (0.20, 390, 775, 0.4884, 457612.96), (0.21, 388, 748, 0.4949, 455496.49),
    (0.22, 388, 723, 0.5029, 455746.49), (0.23, 386, 688, 0.5126, 453710.01),
    (0.24, 381, 657, 0.5184, 448053.82), (0.25, 380, 645, 0.5216, 446980.58),
    (0.26, 377, 628, 0.5247, 443570.86), (0.27, 372, 606, 0.5277, 437824.67),
    (0.28, 371, 592, 0.5319, 436771.43), (0.29, 365, 573, 0.5328, 429802.00),
    (0.30, 364, 557, 0.5381, 428768.76), (0.31, 362, 547, 0.5399, 426482.29),
    (0.32, 357, 528, 0.5421, 420706.10), (0.33, 356, 507, 0.5498, 419722.86),
    (0.34, 354, 491, 0.5544, 417496.38), (0.35, 354, 477, 0.5606, 417636.38),
    (0.36, 352, 465, 0.5637, 415369.90), (0.37, 351, 454, 0.5675, 414286.67),
    (0.38, 348, 446, 0.5677, 410786.95), (0.39, 347, 436, 0.5712, 409693.71),
    (0.40, 346, 420, 0.5776, 408660.47), (0.41, 346, 406, 0.5845, 408800.47),
    (0.42, 344, 395, 0.5875, 406524.00), (0.43, 340, 379, 0.5908, 401911.04),
    (0.44, 336, 365, 0.5931, 397278.09), (0.45, 335, 352, 0.5987, 396214.85),
    (0.46, 330, 340, 0.5989, 390368.66), (0.47, 324, 329, 0.5972, 383319.23),
    (0.48, 319, 318, 0.5968, 377463.04), (0.49, 316, 298, 0.6042, 374083.32),
    (0.50, 306, 289, 0.5959, 362240.94), (0.51, 301, 282, 0.5931, 356344.75),
    (0.52, 298, 266, 0.5984, 352925.03), (0.53, 293, 250, 0.6010, 347118.84),
    (0.54, 290, 243, 0.6010, 343609.13), (0.55, 287, 236, 0.6010, 340099.41),
    (0.56, 283, 228, 0.6002, 335406.46), (0.57, 276, 216, 0.5974, 327173.79),
    (0.58, 273, 200, 0.6033, 323754.07), (0.59, 268, 192, 0.6009, 317867.88),
    (0.60, 265, 181, 0.6036, 314398.17), (0.61, 264, 173, 0.6076, 313284.93),
    (0.62, 261, 164, 0.6091, 309795.21), (0.63, 258, 160, 0.6071, 306255.50),
    (0.64, 255, 157, 0.6043, 302705.78), (0.65, 249, 149, 0.6000, 295626.35),
    (0.66, 243, 141, 0.5956, 288546.92), (0.67, 236, 135, 0.5878, 280254.25),
    (0.68, 234, 130, 0.5879, 277917.78), (0.69, 227, 124, 0.5798, 269625.11),
    (0.70, 225, 120, 0.5792, 267278.63), (0.71, 219, 114, 0.5725, 260179.20),
    (0.72, 218, 110, 0.5737, 259025.96), (0.73, 214, 106, 0.5691, 254293.01),
    (0.74, 209, 103, 0.5618, 248356.82), (0.75, 207, 96, 0.5633, 246040.34),
    (0.76, 201, 88, 0.5576, 238960.91), (0.77, 196, 84, 0.5506, 233034.72),
    (0.78, 186, 81, 0.5322, 221132.34), (0.79, 179, 81, 0.5173, 212779.67),
    (0.80, 172, 76, 0.5059, 204477.00), (0.81, 162, 72, 0.4865, 192584.61),
]

# Published metrics at the F1 threshold 0.44 on the same rows
AT_044 = dict(tp=336, fp=365, tn=1203, fn=96, precision=0.4793, recall=0.7778, accuracy=0.7695,
              f1=0.5931, false_alarm_rate=0.2328)


def scored_rows():
    """(score, label) rows that reproduce the curve: mid-step scores."""
    rows = []
    for i, (t, tp, fp, _, _) in enumerate(CURVE):
        nxt_tp, nxt_fp = (CURVE[i + 1][1], CURVE[i + 1][2]) if i + 1 < len(CURVE) else (0, 0)
        s = round(t + 0.005, 3)
        rows += [(s, 1)] * (tp - nxt_tp) + [(s, 0)] * (fp - nxt_fp)
    rows += [(0.1, 1)] * (POSITIVES - CURVE[0][1]) + [(0.1, 0)] * (NEGATIVES - CURVE[0][2])
    return rows
