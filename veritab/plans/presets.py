"""Ready-made table specs."""

from __future__ import annotations

from veritab.spec import CATEGORY, CODED, NUMERIC, TableSpec, UnitChange

# Codes, labels, ranges, impossible values and unit conversions of the clinical table.
CLINICAL = TableSpec(
    name="clinical",
    id_col="record_id",
    columns={
        "age": NUMERIC, "sex": CATEGORY, "cp": CATEGORY, "trestbps": NUMERIC, "chol": NUMERIC,
        "fbs": CODED, "restecg": CATEGORY, "thalach": NUMERIC, "exang": CODED,
        "oldpeak": NUMERIC, "slope": CODED, "ca": CODED, "thal": CATEGORY,
    },
    target="num",
    ranges={
        "age": (18, 100), "trestbps": (80, 220), "chol": (100, 600),
        "thalach": (60, 220), "oldpeak": (0, 7),
    },
    allowed={
        "sex": ("female", "male"),
        "cp": ("typical_angina", "atypical_angina", "non_anginal", "asymptomatic"),
        "restecg": ("normal", "st_t_abnormality", "lv_hypertrophy"),
        "thal": ("normal", "fixed_defect", "reversible_defect"),
    },
    bad_values={
        "age": (250, -5, 150, 0),
        "trestbps": (900, 0, 400, 300),
        "chol": (0, 1500, 2000),
        "thalach": (450, 0, 300),
        "oldpeak": (-3.0, 15.0, 25.0),
    },
    units={
        "chol": UnitChange(38.67, divide=True, digits=1),
        "age": UnitChange(12),
        "trestbps": UnitChange(7.5, divide=True, digits=1),
    },
    nudge=("age", "trestbps", "chol", "thalach"),
    decode={
        "sex": {0: "female", 1: "male"},
        "cp": {1: "typical_angina", 2: "atypical_angina", 3: "non_anginal", 4: "asymptomatic"},
        "restecg": {0: "normal", 1: "st_t_abnormality", 2: "lv_hypertrophy"},
        "thal": {3: "normal", 6: "fixed_defect", 7: "reversible_defect"},
    },
)

# The columns of that table that hold whole numbers.
CLINICAL_WHOLE = ("age", "trestbps", "chol", "thalach", "fbs", "exang", "slope", "ca", "num")

ORDERS = TableSpec(
    name="orders",
    id_col="o_orderkey",
    columns={
        "o_totalprice": NUMERIC, "o_custkey": CODED,
        "o_orderstatus": CATEGORY, "o_orderpriority": CATEGORY,
    },
    ranges={"o_totalprice": (1000, 500000)},
    allowed={
        "o_orderstatus": ("F", "O", "P"),
        "o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
    },
    bad_values={"o_totalprice": (-5, 0, 9999999)},
    units={"o_totalprice": UnitChange(100, divide=True, digits=1)},
    nudge=("o_totalprice",),
)

PART = TableSpec(
    name="part",
    id_col="p_partkey",
    columns={"p_retailprice": NUMERIC, "p_size": NUMERIC, "p_type": CATEGORY, "p_brand": CATEGORY},
    ranges={"p_retailprice": (910, 990), "p_size": (1, 50)},
    allowed={"p_type": ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")},
    bad_values={"p_size": (-1, 0, 900)},
    units={"p_retailprice": UnitChange(100, divide=True, digits=1)},
    nudge=("p_size",),
)

CUSTOMER = TableSpec(
    name="customer",
    id_col="c_custkey",
    columns={"c_acctbal": NUMERIC, "c_nationkey": CODED, "c_mktsegment": CATEGORY},
    ranges={"c_acctbal": (0, 9000)},
    allowed={"c_mktsegment": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")},
    nudge=("c_acctbal",),
)

EVENTS = TableSpec(
    name="events",
    id_col="event_id",
    columns={"value": NUMERIC, "user_id": CODED, "event_type": CATEGORY},
    ranges={"value": (1, 300)},
    allowed={"event_type": ("click", "purchase", "signup", "view")},
    bad_values={"value": (-1, 100000)},
    units={"value": UnitChange(1000)},
    nudge=("value",),
)

LINEITEM = TableSpec(
    name="lineitem",
    id_col="line_id",
    columns={
        "l_quantity": NUMERIC, "l_extendedprice": NUMERIC, "l_discount": NUMERIC, "l_tax": NUMERIC,
        "l_returnflag": CATEGORY, "l_linestatus": CATEGORY,
    },
    ranges={
        "l_quantity": (2, 49), "l_extendedprice": (1000, 100000),
        "l_discount": (0, 0.09), "l_tax": (0, 0.08),
    },
    allowed={"l_returnflag": ("A", "N"), "l_linestatus": ("F", "O")},
)
