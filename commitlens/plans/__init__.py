"""Load jobs and registered queries."""
