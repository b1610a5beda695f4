"""Operations of a training-data pipeline, one module each. Nothing outside this subpackage imports it."""
