"""See the package README section for the contents of this subpackage."""
