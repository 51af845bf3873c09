"""JSON decoding that refuses text behind the value."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value, else null.

    The parser stops after the first value and ignores what follows. Inside a
    list and inside an object nothing can follow unnoticed: no text is valid in
    both unless it is exactly one value.
    """
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(in_list.isNotNull(), F.try_variant_get(in_object, "$.v", "variant"))
