"""Schemas of the fact tables, as DDL."""

from __future__ import annotations

STYLE_VALUES = (
    "file string, line int, column int, ord int, property string, value string, authored string, source string, selector string, "
    "classNames array<string>, important boolean, dynamic boolean, appliedTo struct<kind:string,name:string,slot:string>")
ELEMENTS = (
    "file string, line int, column int, ord int, name string, resolvedFrom string, kitComponent string, props map<string,string>, "
    "propExpressions map<string,string>, eventHandlers array<string>, keysHandled array<string>, text string, hasLabelAncestor boolean")
IMPORTS = "file string, line int, column int, ord int, specifier string, names array<struct<imported:string,local:string,typeOnly:boolean>>, defaultImport string, typeOnly boolean"
DECLARATIONS = (
    "file string, line int, column int, ord int, name string, kind string, props array<string>, ariaRoles array<string>, ariaAttributes array<string>, "
    "nativeTags array<string>, astSignature array<string>, elementCount int, usages int, kitComponentsUsed array<string>, cssProperties array<string>")
LINT_MESSAGES = "file string, line int, column int, ord int, rule string, message string"
LIMITATIONS = "file string, line int, reason string, detail string"
FINDING_ROW = (
    "rule string, subkind string, category string, severity string, confidence double, file string, line int, column int, ord int, actual string, expected string, impactKey string")
FINDING = ("rule", "subkind", "category", "severity", "confidence", "file", "line", "column", "ord", "actual", "expected", "impactKey")

#: Severities with their rank and weight; categories in report order.
SEVERITIES = [("error", 0, 3.0), ("warning", 1, 1.0), ("info", 2, 0.25), ("candidate", 3, 0.0)]
