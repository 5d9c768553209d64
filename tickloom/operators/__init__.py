"""DataFrame -> DataFrame operators over (session, entity, time) tables."""
