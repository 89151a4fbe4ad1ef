"""Plans that several operators share: tables in the shared folder, connected components, grid joins."""
