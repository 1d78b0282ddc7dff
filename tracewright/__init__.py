"""Recording analytics expressed as lazy DataFrame operators."""
