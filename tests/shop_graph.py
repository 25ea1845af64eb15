"""The call graph of an invented shop: a basket, shelves to take from, money, mail and one test."""

from pyspark.sql import Row, types as T

_COLUMNS = {
    "id": T.LongType(), "fqn": T.StringType(), "name": T.StringType(), "kind": T.StringType(), "file_path": T.StringType(), "line_start": T.IntegerType(), "line_end": T.IntegerType(),
    "column_start": T.IntegerType(), "column_end": T.IntegerType(), "docstring": T.StringType(), "declared_rules": T.StringType(), "language": T.StringType(), "conventional_fqn": T.StringType(),
    "canonical_fqn": T.StringType(), "parent_symbol_id": T.LongType(), "visibility": T.StringType(), "is_test": T.BooleanType(), "is_entry_point": T.BooleanType(), "entry_point_reason": T.StringType(),
    "importance": T.DoubleType(),
}
SYMBOL_TYPE = T.StructType([T.StructField(n, t) for n, t in _COLUMNS.items()])
EDGE_TYPE = (
    "id long, source_symbol_id long, target_symbol_id long, edge_type string, source_range array<int>, target_range array<int>, resolution_tier string, resolved boolean, "
    "target_raw string, properties map<string,string>"
)

#: id, kind, name, file, first line, last line and what is unusual.
_SHOP = [
    (101, "class", "Basket", "shop/basket.ts", 1, 30, {"is_entry_point": True}), (102, "method", "addLine", "shop/basket.ts", 4, 9, {"parent_symbol_id": 101}),
    (103, "method", "sum", "shop/basket.ts", 12, 20, {"parent_symbol_id": 101}), (110, "interface", "Shelf", "shop/shelf.ts", 1, 5, {}), (111, "method", "take", "shop/shelf.ts", 2, 2, {"parent_symbol_id": 110}),
    (120, "class", "Depot", "shop/depot.ts", 1, 9, {}), (121, "method", "take", "shop/depot.ts", 3, 7, {"parent_symbol_id": 120}), (130, "class", "Kiosk", "shop/kiosk.ts", 1, 8, {}),
    (131, "method", "take", "shop/kiosk.ts", 2, 6, {"parent_symbol_id": 130}), (140, "function", "centsOf", "shop/money.ts", 1, 5, {}), (141, "function", "taxOn", "shop/money.ts", 7, 12, {"importance": 4.0}),
    (150, "function", "notify", "shop/mail.ts", 1, 7, {"visibility": "private"}), (151, "function", "retry", "shop/mail.ts", 9, 15, {}),
    (160, "function", "checkBasket", "tests/basket.test.ts", 1, 9, {"is_test": True, "is_entry_point": True}), (170, "class", "Voucher", "shop/voucher.ts", 1, 7, {}), (171, "class", "GiftVoucher", "shop/voucher.ts", 9, 15, {}),
]
#: id, source, target (or what is written), type, line.
_USES = [
    (1, 103, 141, "CALLS", 13), (2, 141, 140, "CALLS", 8), (3, 103, 140, "CALLS", 14), (4, 160, 102, "CALLS", 3), (5, 102, 111, "CALLS", 5), (6, 120, 110, "IMPLEMENTS", None), (7, 130, 120, "INHERITS", None),
    (8, 171, 170, "INHERITS", None), (9, 151, 151, "CALLS", 11), (10, 140, 140, "CALLS", 90), (11, 150, "smtp.push", "CALLS", 3), (12, 150, None, "CALLS", 4), (13, 160, 141, "CALLS", 5), (14, 103, 141, "CALLS", 15),
]


def shop(spark):
    symbols = []
    for i, kind, name, path, first, last, unusual in _SHOP:
        values = {c: None for c in _COLUMNS} | {
            "id": i, "fqn": f"{path}::{name}", "name": name, "kind": kind, "file_path": path, "line_start": first, "line_end": last, "language": "typescript", "conventional_fqn": name,
            "visibility": "public", "is_test": False, "is_entry_point": False, "importance": 0.0,
        }
        symbols.append(Row(**(values | unusual)))
    edges = []
    for i, source, target, kind, line in _USES:
        found = isinstance(target, int)
        edges.append((i, source, target if found else None, kind, [line, 2, line, 20] if line else None, None, "exact" if found else "ambiguous", found, None if found else target, {"arg_count": "1"} if i == 1 else {}))
    return spark.createDataFrame([tuple(r[c] for c in _COLUMNS) for r in symbols], SYMBOL_TYPE), spark.createDataFrame(edges, EDGE_TYPE)
