"""Input mappings of the driver tables onto the operator data model, and the
registered query plans (see ``registry``)."""
