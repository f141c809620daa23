"""Records into dataclasses and pydantic models, and helpers for enums and containers."""

from __future__ import annotations

import dataclasses
from enum import Enum
from typing import Any

MISSING = dataclasses.MISSING


# ---- dataclasses


def is_dataclass(cls: Any) -> bool:
    return isinstance(cls, type) and dataclasses.is_dataclass(cls)


def get_dataclass_field_list(cls: type) -> list[str]:
    return [f.name for f in dataclasses.fields(cls)]


def get_dataclass_field_types(cls: type) -> dict[str, Any]:
    return {f.name: f.type for f in dataclasses.fields(cls)}


def get_field_defaults(cls: type) -> dict[str, Any]:
    """Defaults, those of factories made anew."""
    out = {f.name: f.default for f in dataclasses.fields(cls) if f.default is not MISSING}
    return out | {f.name: f.default_factory() for f in dataclasses.fields(cls) if f.default_factory is not MISSING}


def get_required_fields(cls: type) -> list[str]:
    have = get_field_defaults(cls)
    return [n for n in get_dataclass_field_list(cls) if n not in have]


def get_optional_fields(cls: type) -> list[str]:
    have = get_field_defaults(cls)
    return [n for n in get_dataclass_field_list(cls) if n in have]


def create_all_none_dataclass(cls: type) -> Any:
    return cls(**dict.fromkeys(get_dataclass_field_list(cls)))


def create_dataclass_with_defaults(cls: type) -> Any:
    return cls(**dict.fromkeys(get_dataclass_field_list(cls)) | get_field_defaults(cls))


def is_dataclass_object_all_none(obj: Any, consider_empty_as_none: bool = False) -> bool:
    values = [getattr(obj, n) for n in get_dataclass_field_list(type(obj))]
    return all(v is None or (consider_empty_as_none and is_empty(v)) for v in values)


def map_dict_to_dataclass(record: dict[str, Any] | None, cls: type | None, mapping: dict[str, str] | None = None, apply_defaults: bool = False) -> Any:
    """mapping: field -> key of the record. Missing values are None, or the field's default where asked for."""
    if cls is None:
        return None
    record, mapping = record or {}, mapping or {}
    defaults = get_field_defaults(cls) if apply_defaults else {}
    values = {n: record.get(mapping.get(n, n)) for n in get_dataclass_field_list(cls)}
    return cls(**{n: defaults.get(n) if v is None else v for n, v in values.items()})


def map_tuple_to_dataclass(record: tuple | None, cls: type | None, field_order: list[str] | None = None, apply_defaults: bool = False) -> Any:
    names = field_order or (get_dataclass_field_list(cls) if cls else [])
    return map_dict_to_dataclass(dict(zip(names, record or (), strict=False)), cls, None, apply_defaults)


def map_namedtuple_to_dataclass(record: Any, cls: type | None, mapping: dict[str, str] | None = None, apply_defaults: bool = False) -> Any:
    return map_dict_to_dataclass(record._asdict() if record is not None else None, cls, mapping, apply_defaults)


def map_list_of_dicts_to_dataclasses(records: list[dict], cls: type, mapping: dict[str, str] | None = None, apply_defaults: bool = False) -> list[Any]:
    return [map_dict_to_dataclass(r, cls, mapping, apply_defaults) for r in records or []]


def map_list_of_tuples_to_dataclasses(records: list[tuple], cls: type, field_order: list[str] | None = None, apply_defaults: bool = False) -> list[Any]:
    return [map_tuple_to_dataclass(r, cls, field_order, apply_defaults) for r in records or []]


def map_list_of_namedtuples_to_dataclasses(records: list[Any], cls: type, mapping: dict[str, str] | None = None, apply_defaults: bool = False) -> list[Any]:
    return [map_namedtuple_to_dataclass(r, cls, mapping, apply_defaults) for r in records or []]


# ---- pydantic models


def map_dict_to_pydantic(record: dict[str, Any] | None, cls: type | None, mapping: dict[str, str] | None = None) -> Any:
    """mapping: field -> key of the record; keys that are no field are left out, validation is the model's."""
    if cls is None or record is None:
        return None
    mapping = mapping or {}
    return cls.model_validate({n: record[mapping.get(n, n)] for n in cls.model_fields if mapping.get(n, n) in record})


def map_tuple_to_pydantic(record: tuple | None, cls: type | None, field_order: list[str] | None = None) -> Any:
    if cls is None or record is None:
        return None
    return map_dict_to_pydantic(dict(zip(field_order or list(cls.model_fields), record, strict=False)), cls)


def map_namedtuple_to_pydantic(record: Any, cls: type | None, mapping: dict[str, str] | None = None) -> Any:
    return map_dict_to_pydantic(record._asdict() if record is not None else None, cls, mapping)


def map_list_of_dicts_to_pydantic(records: list[dict], cls: type, mapping: dict[str, str] | None = None) -> list[Any]:
    return [map_dict_to_pydantic(r, cls, mapping) for r in records or []]


def map_list_of_tuples_to_pydantic(records: list[tuple], cls: type, field_order: list[str] | None = None) -> list[Any]:
    return [map_tuple_to_pydantic(r, cls, field_order) for r in records or []]


def map_list_of_namedtuples_to_pydantic(records: list[Any], cls: type, mapping: dict[str, str] | None = None) -> list[Any]:
    return [map_namedtuple_to_pydantic(r, cls, mapping) for r in records or []]


# ---- enums and containers


def is_enum(cls: Any) -> bool:
    return isinstance(cls, type) and issubclass(cls, Enum)


def _checked(cls: type) -> type:
    if not is_enum(cls):
        raise TypeError(f"{cls!r} is no Enum")
    return cls


def member_identities(cls: type) -> list[Enum]:
    return list(_checked(cls))


def member_names(cls: type) -> list[str]:
    return [m.name for m in _checked(cls)]


def member_values(cls: type) -> list[Any]:
    return [m.value for m in _checked(cls)]


def is_valid_member_name(cls: type, name: str) -> bool:
    return name in _checked(cls).__members__


def is_valid_member_value(cls: type, value: Any) -> bool:
    return any(value == v and type(value) is type(v) for v in member_values(cls))


def is_valid_member_identity(cls: type, instance: Any) -> bool:
    return isinstance(instance, _checked(cls))


def find_member(cls: type, value: Any) -> Enum | None:
    """The member with a value; aliases give the one they stand for."""
    return next((m for m in _checked(cls) if m.value == value), None)


def find_member_name(cls: type, value: Any) -> str | None:
    found = find_member(cls, value)
    return found.name if found else None


def find_member_names_dict(cls: type, value: Any) -> dict[str, Enum]:
    """All names of a value, aliases included."""
    return {n: m for n, m in _checked(cls).__members__.items() if m.value == value}


def find_all_member_names(cls: type, value: Any) -> list[str]:
    return list(find_member_names_dict(cls, value))


get_enum_attribute_names, get_enum_values = member_names, member_values


def get_enum_values_set(cls: type) -> set:
    return set(member_values(cls))


def get_enum_values_tuple(cls: type) -> tuple:
    return tuple(member_values(cls))


def get_enum_values_dict(cls: type) -> dict[str, Any]:
    return {m.name: m.value for m in _checked(cls)}


def is_empty(value: Any) -> bool:
    """Whether a container, or a string, has nothing in it."""
    return hasattr(value, "__len__") and len(value) == 0
