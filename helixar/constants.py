"""Fixed values of the domain: molecule types, thresholds, cost parameters. All are defaults that callers may replace."""

# Fixed values: (name, internal/external/base, left design, right design, used as is, cost, efficiency, synthesized, min size)
MOLECULE_TYPES = [
    ("PRE-MADE DNA FRAGMENT", "internal", False, False, True, 0.0, 0.98, False, None),
    ("PCR_PRODUCT", "internal", True, True, False, 10.0, 0.95, False, 100),
    ("PCR_PRODUCT_WITH_PRIMERS", "internal", False, False, False, 10.0, 0.95, False, 100),
    ("PCR_PRODUCT_WITH_RIGHT_PRIMER", "internal", True, False, False, 10.0, 0.95, False, 100),
    ("PCR_PRODUCT_WITH_LEFT_PRIMER", "internal", False, True, False, 10.0, 0.95, False, 100),
    ("PRIMER_EXTENSION_PRODUCT_WITH_PRIMERS", "internal", False, False, False, 9.0, 0.95, False, None),
    ("PRIMER_EXTENSION_PRODUCT_WITH_LEFT_PRIMER", "internal", False, True, False, 9.0, 0.95, False, None),
    ("PRIMER_EXTENSION_PRODUCT_WITH_RIGHT_PRIMER", "internal", True, False, False, 9.0, 0.95, False, None),
    ("SHARED_SYNTHESIZED_FRAGMENT", "internal", False, False, True, 1000.0, 0.1, True, 100),
    ("OVERLAP", "external", None, None, False, 0.0, 1.0, False, None),
    ("GAP", "external", None, None, False, 0.0, 1.0, True, None),
    ("__MISSING", "base", None, None, False, float("inf"), 0.0, False, None),
    ("PRIMER", "base", None, None, False, float("inf"), 0.0, False, None),
    ("TEMPLATE", "base", None, None, True, 0.0, 0.0, False, None),
    ("FRAGMENT_SHARED_WITH_OTHER_QUERIES", "base", None, None, True, 0.0, 1.0, True, None),
    ("PLASMID", "base", None, None, False, 0.0, 1.0, False, None),
]
MOLECULE_SCHEMA = "name string, kind string, l boolean, r boolean, direct boolean, cost double, efficiency double, synthesize boolean, min_size int"

FRAGMENT, PCR, PCR_PRIMERS, PCR_RIGHT, PCR_LEFT = (x[0] for x in MOLECULE_TYPES[:5])
EXT_PRIMERS, EXT_LEFT, EXT_RIGHT, SHARED = (x[0] for x in MOLECULE_TYPES[5:9])
OVERLAP, GAP, MISSING, PRIMER, TEMPLATE = "OVERLAP", "GAP", "__MISSING", "PRIMER", "TEMPLATE"

# thresholds
MIN_BIND = 14
MIN_OVERLAP = 15
COST_THRESHOLD = 10_000.0
REPEAT_K, STATS_WINDOW, HAIRPIN_K = 14, 20, 20
MIN_ANNEAL, MAX_ANNEAL = 12, 30
MISPRIMING_PENALTY = 0.5
COMPLEXITY_THRESHOLD = 10.0
EDGE_EFFICIENCY = 0.05
NOT_SYNTHESIZABLE = 0.1
PCR_BANDS = [(4000, 5000, 0.8), (5000, 6000, 0.5), (6000, 1000, 0.2)]
PARTITION_OVERLAP, PARTITION_STEP = 30, 10
MIN_GENE = 100
BASE_FRACTION, GC_FRACTION, AT_FRACTION = 0.75, 0.85, 0.90
