"""Operators for preparing training corpora. Nothing else in the engine imports this subpackage."""
