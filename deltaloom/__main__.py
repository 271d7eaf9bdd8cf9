from deltaloom.cli import main

main()
