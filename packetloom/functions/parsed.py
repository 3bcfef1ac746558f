"""JSON text expressions."""
from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT = "map<string,string>"


def object_text(content: Column, needs: list[str]) -> Column:
    """The JSON object in a text: the text itself, else first '{' to last '}'.

    NULL unless it is an object that has one of the needed keys.
    """
    whole = F.trim(F.coalesce(content, F.lit("")))
    first = F.instr(whole, "{")
    tail = F.length(whole) - F.instr(F.reverse(whole), "}") + 1
    inner = F.when((first > 0) & whole.contains("}") & (tail >= first),
                   F.substring(whole, first, tail - first + 1))

    def keep(text: Column) -> Column:
        keys = F.json_object_keys(text)
        return F.when(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in needs])), text)

    return F.coalesce(keep(whole), keep(inner))


def string_items(body: Column, path: str) -> Column:
    """A JSON array field as trimmed, non-empty strings."""
    items = F.from_json(F.get_json_object(body, f"$.{path}"), "array<string>")
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")),
                                lambda a: F.trim(a)), lambda a: a != "")


def whole_number(text: Column) -> Column:
    """Integer value of a citation; NULL for words, fractions written as text, NULL."""
    clean = F.trim(text)
    number = F.when(clean.rlike(r"^[+-]?\d+$"), clean.try_cast("long"))
    return F.coalesce(number, F.when(clean.rlike(r"^-?\d+\.\d+$"), F.floor(clean.try_cast("double")).cast("long")))
