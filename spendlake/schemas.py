"""Fixed schemas of the notice table, the lake and the landed JSON payloads."""

from __future__ import annotations

from pyspark.sql import types as T

AMOUNT = T.DecimalType(18, 2)


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


# One contract notice. ``raw_file``/``raw_row`` say where a spreadsheet row came from.
NOTICE = T.StructType(
    _strings("source", "contract_id", "release_id", "ocid", "supplier", "agency", "title")
    + [
        T.StructField("amount", AMOUNT),
        T.StructField("release_date", T.TimestampType()),
        T.StructField("contract_end", T.DateType()),
    ]
    + _strings("tag", "fy", "month", "agency_key", "company_key", "raw_file")
    + [T.StructField("raw_row", T.LongType())]
)
NOTICE_COLUMNS = NOTICE.fieldNames()

# Row of a lake written by earlier tools: plain column names, or the literal prefix "name=".
LEGACY_ROW = T.StructType(
    _strings(
        "partition", "source", "financial_year", "agency_key", "company_key", "contract_id",
        "release_id", "ocid", "supplier", "agency", "title",
    )
    + [
        T.StructField("amount", T.DoubleType()),
        T.StructField("release_epoch_ms", T.LongType()),
        T.StructField("is_update", T.BooleanType()),
    ]
)

OCDS_RELEASE = T.StructType(
    _strings("id", "ocid", "date")
    + [
        T.StructField("tag", T.ArrayType(T.StringType())),
        T.StructField(
            "parties",
            T.ArrayType(
                T.StructType(
                    _strings("name") + [T.StructField("roles", T.ArrayType(T.StringType()))]
                )
            ),
        ),
        T.StructField("tender", T.StructType(_strings("description", "procurementMethodDetails"))),
        T.StructField(
            "contracts",
            T.ArrayType(
                T.StructType(
                    _strings("id", "title", "description")
                    + [
                        T.StructField("value", T.StructType([T.StructField("amount", AMOUNT)])),
                        T.StructField(
                            "amendments",
                            T.ArrayType(
                                T.StructType(
                                    _strings("id")
                                    + [
                                        T.StructField("amendedvalue", AMOUNT),
                                        T.StructField("contractamendmentvalue", AMOUNT),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)
OCDS_PACKAGE = T.StructType(
    [
        T.StructField("errorCode", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("links", T.StructType(_strings("next"))),
        T.StructField("releases", T.ArrayType(OCDS_RELEASE)),
    ]
)

CATALOGUE_PAGE = T.StructType(
    [
        T.StructField("success", T.BooleanType()),
        T.StructField(
            "result",
            T.StructType(
                [
                    T.StructField("count", T.LongType()),
                    T.StructField(
                        "results",
                        T.ArrayType(
                            T.StructType(
                                _strings("id", "name", "title")
                                + [T.StructField("organization", T.StructType(_strings("id", "name", "title")))]
                                + _strings("metadata_modified")
                                + [
                                    T.StructField(
                                        "resources",
                                        T.ArrayType(
                                            T.StructType(
                                                # size is a number or a string
                                                _strings(
                                                    "id", "package_id", "name", "url", "format",
                                                    "last_modified", "created", "size",
                                                )
                                            )
                                        ),
                                    )
                                ]
                            )
                        ),
                    ),
                ]
            ),
        ),
    ]
)
